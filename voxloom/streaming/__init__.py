"""Streaming of the volumetric sample engine."""
