"""Point-cloud analytics expressed as Spark plans over point tables."""

__version__ = "0.1.0"
