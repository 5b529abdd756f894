"""Training-data operators: tokenising, cleaning, near-duplicate removal, search and packing.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
