"""Operators for large training-data corpora: archives, search, dedup, packing, tokens, filters.

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; its query and any oracle SQL are registered in ``farelens.llm.queries``.
"""
