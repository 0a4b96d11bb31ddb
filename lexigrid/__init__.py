"""lexigrid: Spark-native analytics for finding overly similar items in large text banks."""
