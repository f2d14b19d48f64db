"""prepkit: tabular data preparation and what-if scoring as plain Spark DataFrame work."""
