"""Column expressions: text cleaning, affinity units, labels, sequences, similarity."""
