"""A PySpark engine that finds and removes personal data in large text corpora."""

__version__ = "0.1.0"
