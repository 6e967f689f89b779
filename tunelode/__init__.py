"""tunelode: a Spark-native analytics engine for media-library and text-corpus data."""
