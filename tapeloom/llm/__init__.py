"""Operators for preparing training data for language models, each a Spark job over whole tables."""
