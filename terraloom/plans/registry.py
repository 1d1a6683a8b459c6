"""Every query of the library's own operators, with the SQL that states its result."""

from __future__ import annotations

from terraloom.plans import join_queries, mask_queries, scene_queries, series_queries, spatial_queries, stats_queries, store_queries  # noqa: F401  (they enter their queries)
from terraloom.plans.catalog import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "f01_poly_lin"
