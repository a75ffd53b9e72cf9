"""Inkfold: document-corpus analytics as Spark DataFrame transforms."""
