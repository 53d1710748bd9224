"""Scalar functions: column expressions and byte codecs."""
