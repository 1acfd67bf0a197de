"""Detectors and joins: DataFrame in, DataFrame out."""
