"""pressgrid: a PySpark-native analytics engine for press and media corpora."""
