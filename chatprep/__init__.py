"""Spark library for preparing, masking, sampling and scoring chat corpora."""

__version__ = "0.1.0"
