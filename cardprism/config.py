"""Configuration of the segmentation pipeline.

One frozen dataclass replaces the reference's global dict: every stage takes
its parameters (and the single seed) from here, so a run is reproducible
from the config object alone.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

# --- Fixed values that must equal the reference for identical results -----
# Expected raw transaction columns, in the reference's order.
EXPECTED_COLUMNS = (
    "transaction_id", "transaction_timestamp", "card_id", "expiry_date",
    "issuer_bank_name", "merchant_id", "merchant_mcc", "merchant_city",
    "transaction_type", "transaction_amount_kzt", "original_amount",
    "transaction_currency", "acquirer_country_iso", "pos_entry_mode", "wallet_type",
)
# Weekend = Saturday, Sunday with Monday = 0; holiday season months.
WEEKEND_DAYS = (5, 6)
HOLIDAY_MONTHS = (11, 12, 1)
# Day parts: half-open hour ranges [start, end).
DAY_PARTS = (("night", 0, 6), ("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24))
BASE_CURRENCY = "KZT"
CONTACTLESS_MODE = "Contactless"
COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SegmentationConfig:
    seed: int = 42
    # feature engineering
    weekend_days: tuple = WEEKEND_DAYS
    holiday_months: tuple = HOLIDAY_MONTHS
    day_parts: tuple = DAY_PARTS
    base_currency: str = BASE_CURRENCY
    contactless_mode: str = CONTACTLESS_MODE
    median_mode: str = "exact"          # "exact" | "spread" (exact, for cards that hold much of the data) | "approx"
    # preprocessing
    scaler: str = "robust"              # "robust" | "standard"
    correlation_threshold: float = 0.8
    pca_variance_ratio: float = 0.95
    power_transform: bool = True
    power_on_error: str = "raise"       # "raise" | "skip"
    # clustering
    algorithm: str = "gmm_auto"         # gmm | gmm_auto | kmeans | hdbscan | any other -> all
    gmm_components: tuple = (3, 4, 5, 6, 7)
    gmm_covariance_types: tuple = COVARIANCE_TYPES
    gmm_auto_min: int = 2
    gmm_auto_max: int = 8
    gmm_auto_criterion: str = "bic"     # bic | aic | combined
    gmm_max_iter: int = 100
    gmm_tol: float = 1e-3
    gmm_reg_covar: float = 1e-6
    kmeans_k: tuple = (3, 4, 5, 6, 7, 8)
    kmeans_restarts: int = 10
    kmeans_max_iter: int = 300
    density_min_cluster_sizes: tuple = (5, 10, 15, 20, 30, 50)
    density_min_samples: tuple = (3, 5, 10, 15)
    # scoring of candidates: None = exact silhouettes, O(n^2); a number = an
    # estimate from so many points of each cluster, O(n), with standard error
    silhouette_sample: int | None = None

    def with_seed(self, seed: int) -> "SegmentationConfig":
        """Seed propagation: one value feeds every seeded stage."""
        return dataclasses.replace(self, seed=seed)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)
