"""medialake: Spark-native analytics over large media and document libraries."""
