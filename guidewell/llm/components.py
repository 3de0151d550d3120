"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, opaque


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with ``m``, the least node among u and all its neighbours in ``edges``.

    The least neighbours are one row per node; their key is made opaque so that both sides of the join are exchanged and AQE can split a node with many edges.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(opaque("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least.hint("merge"), F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Return (node, component): for each node of an edge its component's least node, itself excluded as a row of its own.

    ``edges`` has two long columns; rows with nulls or u = v are ignored, repeats do no harm, no edges give no rows.
    Only nodes that are not the least of their component are returned. Each round is written to the shared folder,
    so a lost executor costs one round; nothing is collected but a count and a checksum.
    """
    now = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v"))
    now = cut(now.where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = cut(small.distinct(), "edges")
        was, state = state, _state(after)
        drop(now)
        now = after
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if state[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
