"""All queries of the volumetric engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from voxloom.plans import analysis_queries, catalog_queries, class_queries, dataset_queries, kernel_queries, spatial_queries, tomogram_queries, volume_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for family in (class_queries, volume_queries, spatial_queries, catalog_queries, kernel_queries, dataset_queries, analysis_queries, tomogram_queries):
    QUERIES |= family.QUERIES
    ORACLE_SQL |= family.ORACLE_SQL
