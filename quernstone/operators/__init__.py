"""Relational operators: chunking, search, retrieval, catalog, prompts, tasks and evaluation."""
