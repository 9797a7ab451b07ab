"""Operators for large training-data pipelines: filtering, de-duplication, counting, extraction and mixing.

Nothing outside this subpackage imports it; ``turnmill.llm.queries`` registers its queries.
"""
