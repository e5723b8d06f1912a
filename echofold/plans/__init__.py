"""Named queries over the driver tables, with the SQL that each must agree with."""

from __future__ import annotations

from echofold.plans import admission_queries, association_queries, census_queries, comparison_queries, function_queries, horizon_queries, joint_queries, matrix_queries, relational_queries, scalar_queries, sink_queries, solver_queries, source_queries, stream_queries, temporal_queries

FLAGSHIP = "coactivity_bins"
_SETS = (temporal_queries, relational_queries, association_queries, horizon_queries, comparison_queries, admission_queries, census_queries, scalar_queries, source_queries, matrix_queries, stream_queries, solver_queries, sink_queries, joint_queries, function_queries)
QUERIES = {k: v for s in _SETS for k, v in s.QUERIES.items()}
ORACLE_SQL = {k: v for s in _SETS for k, v in s.ORACLE_SQL.items()}
