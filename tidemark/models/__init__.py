"""Forecaster, cross-validation, tuning and ensembles."""
