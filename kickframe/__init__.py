"""Football match analytics as Spark DataFrame operators."""
