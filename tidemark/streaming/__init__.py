"""Streams of scans."""
