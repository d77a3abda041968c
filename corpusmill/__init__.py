"""A PySpark-native engine for evidence corpora: DataFrame in, DataFrame out."""
