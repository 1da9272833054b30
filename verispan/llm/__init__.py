"""Operators that prepare text corpora and bibliographic records for model training."""
