"""kindred: record linkage and corpus analytics as Spark DataFrame operators."""
