"""Corpus operators for training-data pipelines: scoring, de-duplication, scans and tokenisation."""
