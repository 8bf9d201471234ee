"""Signal, outcome and ranking analytics as Spark DataFrame programs."""
