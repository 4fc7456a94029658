"""Training-data operators: packing, dedup, search, filters, tokenizer output.

Nothing outside this package imports it. ``weft.llm.queries`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
