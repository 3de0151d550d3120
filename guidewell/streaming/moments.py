"""Group sums over a stream of expression rows: sums merge, so they can be kept up to date as cells arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from guidewell.operators.normalize import normalized
from guidewell.operators.stats import group_sums


def streamed_group_sums(rows: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """``rows``: a stream of row_id, is_control, active, indices, values. For update or complete output; the state has a row per group and gene."""
    return group_sums(normalized(rows, target_sum))
