"""siftlog: search unstructured text by meaning and by exact identifier, on Spark."""

__version__ = "0.1.0"
