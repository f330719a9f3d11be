"""Batch and streaming jobs on entity x date panels, as functions from DataFrame to DataFrame."""
