"""cardprism: behavioural card segmentation expressed as Spark DataFrame jobs.

Transactions -> per-card features -> scaling / decorrelation / PCA / power
transform -> clustering (K-Means, Gaussian mixtures, density) -> quality
scores -> segment profiles and report tables.  Every step is a DataFrame
transformation executed on the cluster; the driver only holds model
parameters whose size is bounded by (#features, #components), never rows.
"""

from cardprism.config import SegmentationConfig

__all__ = ["SegmentationConfig"]
__version__ = "0.1.0"
