"""Import every query module so that the registry is complete."""

from cardprism.plans import q_density, q_features, q_misc, q_models, q_preprocess, q_profiles, q_quality, q_sources  # noqa: F401
from cardprism.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
