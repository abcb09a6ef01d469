"""Exchange tick-data and order-book analytics on PySpark."""

__version__ = "0.1.0"
