"""Curation, sampling and evaluation of language-model training data on Spark."""
