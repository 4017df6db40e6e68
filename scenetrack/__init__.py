"""Finding, measuring and following objects in series of gridded scenes, as Spark DataFrame operators."""
