"""Operators of the volumetric sample engine."""
