"""Queries over the fixture tables, with their oracle SQL."""
