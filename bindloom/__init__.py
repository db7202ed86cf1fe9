"""bindloom: affinity, structure, score and alignment analytics as Spark DataFrame operators."""
