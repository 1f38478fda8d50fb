"""Longitudinal digital-biomarker analytics expressed as Spark DataFrame operators."""
