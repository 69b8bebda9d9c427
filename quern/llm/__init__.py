"""Operators for training-data pipelines: tokens, media, language, licences,
urls, duplicates, quality and contamination.  Nothing else in the library
imports this subpackage."""
