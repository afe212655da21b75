"""emberlog: security-log normalization, detection and lineage on Spark DataFrames."""

__version__ = "0.1.0"
