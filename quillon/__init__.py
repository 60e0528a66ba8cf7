"""quillon: a PySpark-native engine for rail networks, timetables and corpora."""

__version__ = "0.1.0"
