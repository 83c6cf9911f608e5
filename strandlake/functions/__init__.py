"""Strandlake functions."""
