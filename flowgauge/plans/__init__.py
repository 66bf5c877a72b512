"""Whole runs: prepare a dataset, evaluate detectors on it."""
