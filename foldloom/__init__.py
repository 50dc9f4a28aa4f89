"""Evaluation-data engine on Spark: rules, leakage-free splits, metrics and fingerprints."""
