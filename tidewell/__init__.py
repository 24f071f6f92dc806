"""tidewell: an ordered, dynamically typed document store and query engine on PySpark."""

__version__ = "0.1.0"
