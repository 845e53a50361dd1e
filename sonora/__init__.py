"""sonora: a Spark-native analytics engine for speech-transcript quality."""

__version__ = "0.1.0"
