"""corpusloom: a Spark-native engine for preparing and auditing speech corpora."""

__version__ = "0.1.0"
