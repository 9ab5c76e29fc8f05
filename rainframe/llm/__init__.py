"""Training-data operators on Spark: one module per operator, nothing here is imported elsewhere."""
