"""Strandlake streaming."""
