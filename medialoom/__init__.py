"""medialoom: a Spark-native analytics engine for media libraries and text corpora."""
