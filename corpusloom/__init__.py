"""corpusloom: DataFrame operators for building and measuring training corpora on Spark."""

__version__ = "0.1.0"
