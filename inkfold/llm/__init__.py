"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``inkfold.llm.queries`` holds its
query and SQL registry.
"""
