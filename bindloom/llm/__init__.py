"""Operators of a training-data pipeline on texts, pages and vectors; see ``queries`` for the registered ones."""
