"""Accuracy analytics for building footprints and settlement layers on Spark."""
