"""Whole jobs: build a version, evaluate a benchmark, export the results."""
