"""curbsight: road-incident analytics as Spark DataFrame operators."""
