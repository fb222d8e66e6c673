"""overstrata: a Spark-native engine for layered, override-based content packages."""

__version__ = "0.1.0"
