"""tremorlake: Spark-native analytics for dense sensor-array event data."""
