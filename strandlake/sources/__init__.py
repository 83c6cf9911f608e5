"""Strandlake sources."""
