"""A PySpark-native engine for speech transcripts, entity spans and the corpora built from them."""

__version__ = "0.1.0"
