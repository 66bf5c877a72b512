"""Labelled network-flow tables, detectors and their evaluation, as Spark jobs."""
