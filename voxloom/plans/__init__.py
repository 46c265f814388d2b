"""Plans of the volumetric sample engine."""
