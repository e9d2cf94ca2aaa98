"""Relational operators on pixel and cell tables."""
