"""Operators for preparing language-model training data.

One module per operator; ``queries.py`` holds the registered queries and their
SQL.  Nothing outside this package imports it, except the guarded lookup in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
