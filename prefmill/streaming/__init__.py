"""Row-wise operators on arriving files.

Every step from a response to a pair and from a pair to its scores looks at one row only, so the batch
operators run unchanged on a stream. The file source and sink with a checkpoint give each input row
exactly one result, also after a restart, which is the same promise as scoring only what has no result.
"""

from prefmill.streaming.incremental import follow, pairs_from_responses, scores_from_pairs

__all__ = ["follow", "pairs_from_responses", "scores_from_pairs"]
