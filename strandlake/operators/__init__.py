"""Strandlake operators."""
