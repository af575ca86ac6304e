"""Training-data operators on Spark: one module per operator.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
