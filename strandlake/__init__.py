"""Strandlake: k-mer analytics as Spark queries."""

__version__ = "0.1.0"
