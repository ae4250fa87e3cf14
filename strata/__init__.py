"""strata: a Spark-native engine for labelled-text datasets."""
