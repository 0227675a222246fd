"""Spark-first analytics over labelled hierarchies, label text and vectors."""
