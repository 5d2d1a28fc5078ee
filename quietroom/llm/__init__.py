"""Operators of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this package and ``corpus_pipeline.py`` imports it.  Every operator selects
the columns it needs under names of its own, so further columns of an input, whatever they
are called, never get in its way.
"""
