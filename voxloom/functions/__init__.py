"""Functions of the volumetric sample engine."""
