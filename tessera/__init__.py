"""Tessera: a semantic retrieval and entity-resolution engine planned by Spark."""
