"""Readers of delimited, structure, alignment and status files, and writers of results."""
