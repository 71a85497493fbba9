"""The registered queries: each operator run over the given tables, with the SQL it must agree with."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import (  # noqa: F401,E402  (registers the queries)
    q_code,
    q_compare,
    q_evaluation,
    q_files,
    q_lengths,
    q_pairs,
    q_quality,
    q_series,
    q_shapes, q_splits,
    q_taxonomy,
)
