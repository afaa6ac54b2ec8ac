"""Operators over tables: masking, sampling, whole-column changes, privacy analytics, static masking, views, dumps."""
