"""Customer attrition features, checks, models and explanations as Spark plans."""

__version__ = "0.1.0"
