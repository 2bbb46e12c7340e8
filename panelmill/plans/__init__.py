"""Composite pipelines and the factor-model estimator."""
