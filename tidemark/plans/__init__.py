"""Registered queries of the posting engine and their SQL."""
