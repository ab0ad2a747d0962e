"""citegrid: a Spark-native engine for publication-record analytics."""
