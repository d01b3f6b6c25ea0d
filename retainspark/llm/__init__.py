"""Training-data operators: extraction, scoring, search and encoding of text.

Each operator is a module here with a general function over DataFrames; the
thin ``opN_*`` queries that apply them to the driver's tables are registered in
``catalog``.  Nothing outside this package (and ``corpus_pipeline.py``) imports
it.
"""
