"""Spark jobs for large collections of microscopy surveys and text corpora."""
