"""Ontology-driven document analytics on PySpark."""
