"""logweft: a Spark-native search engine over raw, multi-line log files."""
