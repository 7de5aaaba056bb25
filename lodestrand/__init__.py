"""lodestrand: Spark-native analytics over measurement data (entities observed against many targets)."""

__version__ = "0.1.0"
