"""bidlake: procurement analytics as Spark DataFrame operators."""
