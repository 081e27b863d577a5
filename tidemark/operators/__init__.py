"""Operators on tables of postings."""
