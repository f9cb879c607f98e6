"""Document-affinity operators and training-data operators as Spark DataFrame transformations."""
