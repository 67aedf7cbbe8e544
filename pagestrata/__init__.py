"""pagestrata: crawl-audit analytics over page snapshots, declared as Spark DataFrames."""

__version__ = "0.1.0"
