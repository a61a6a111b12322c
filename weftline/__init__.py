"""weftline: Spark-first analytics over crawl records and event streams."""

__version__ = "0.1.0"
