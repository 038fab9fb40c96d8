"""Training-data operators on Spark: filtering, linking, deduplication, encoding and archives."""
