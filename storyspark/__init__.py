"""storyspark: story-stream analytics on Spark."""
