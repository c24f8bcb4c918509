"""Daily market panels on Spark: features, labels, datasets and prediction scoring."""
