"""Operators for large training-data pipelines, each a Spark job.

Nothing outside this folder (but for the guarded import in
``__spark_entry__.py`` and ``corpus_pipeline.py``) imports it. The operators
take a DataFrame and the names of its id and text columns, read only those
columns (extra or clashing columns are ignored) and return their own columns;
``queries`` derives the contract columns of each ``opN_<name>`` query.
"""
