"""lumenfold: hybrid search and corpus processing over file collections, as Spark DataFrame plans."""

__version__ = "0.1.0"
