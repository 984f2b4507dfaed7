"""Readers for document files."""
