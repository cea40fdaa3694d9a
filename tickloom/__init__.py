"""Market-research analytics as Spark DataFrame transformations."""
