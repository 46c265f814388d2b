"""Sources of the volumetric sample engine."""
