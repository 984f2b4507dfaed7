"""Scalar functions: text, vectors and pluggable models."""
