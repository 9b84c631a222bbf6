"""Presets, the pipeline, and the queries with their SQL."""
