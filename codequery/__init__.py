"""codequery: a Spark-native code-retrieval and code-analytics engine."""

__version__ = "0.1.0"
