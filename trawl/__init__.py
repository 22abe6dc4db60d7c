"""trawl: a Spark-native file catalog, ranked search and corpus preparation engine."""
