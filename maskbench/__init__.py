"""maskbench: robustness-study analytics for video segmentation, on Spark DataFrames."""

__version__ = "0.1.0"
