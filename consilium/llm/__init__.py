"""Training-data operators: text in, decisions out, over whole corpora.

Nothing outside this package imports it.  Queries are registered by
``consilium.llm.registry``.
"""
