"""Operators for preparing training text: near-duplicates, packing, scans, classifiers, encoders."""
