"""quarrylight: evidence retrieval, event analytics and training-data preparation on Spark."""
