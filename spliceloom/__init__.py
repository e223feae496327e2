"""Spark-native analytics for transcript models, with a separate text-corpus subpackage."""
