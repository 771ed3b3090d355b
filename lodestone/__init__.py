"""Archives, compressed streams and disk images as queryable Spark tables."""

__version__ = "0.1.0"
