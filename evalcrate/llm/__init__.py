"""Operators of a training-data pipeline (one module per operator).

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries (``llm.queries``) when the folder is present.
"""
