"""Source-line analytics and training-data operators on Spark."""
