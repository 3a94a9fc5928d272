"""Content identification in time series on Spark: fingerprints, index, search, decision."""

__version__ = "0.1.0"
