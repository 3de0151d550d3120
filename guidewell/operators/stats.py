"""Group statistics: fused sums per (perturbation, gene), counts, background accumulators. Group 0 is the control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidewell.functions.expressions import mean, variance
from guidewell.model import broadcast_if_small


def group_counts(cells: DataFrame) -> DataFrame:
    """p_idx, n: controls (0) and modelled cells of each perturbation; one pass, partial counts before the exchange."""
    groups = F.when(F.col("is_control"), F.array(F.lit(0))).otherwise(F.col("active"))
    return cells.select(F.explode(groups).alias("p_idx")).groupBy("p_idx").agg(F.count("*").alias("n"))


def census(matrix: DataFrame) -> dict[int, int]:
    """Counts by group (0 the controls) in one pass: also all cells (-1), modelled cells (-2), and cells by ``fault``: malformed rows (-3), repeated ones (-4)."""
    none = F.array().cast("array<int>")
    groups = F.when(F.col("is_control"), F.array(F.lit(0))).otherwise(F.col("active"))
    marks = F.concat(groups, F.array(F.lit(-1)), F.when(F.col("is_model"), F.array(F.lit(-2))).otherwise(none), F.when(F.col("fault") < 0, F.array("fault")).otherwise(none))
    found = matrix.select(F.explode(marks).alias("p_idx")).groupBy("p_idx").agg(F.count("*").alias("n")).collect()
    return {r["p_idx"]: r["n"] for r in found}


def group_sums(matrix: DataFrame) -> DataFrame:
    """p_idx, gene_id, s, q, lin: sums of y, y * y and z per group; a cell counts for each of its perturbations."""
    groups = F.when(F.col("is_control"), F.array(F.lit(0))).otherwise(F.col("active"))
    rows = matrix.select(groups.alias("groups"), F.explode("entries").alias("e")).select(F.explode("groups").alias("p_idx"), "e.gene_id", "e.z", "e.y")
    return rows.groupBy("p_idx", "gene_id").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"), F.sum("z").alias("lin"))


def union_entries(matrix: DataFrame, union: DataFrame, *columns: str, n_union: int = 0) -> DataFrame:
    """Entry rows (columns, gene_id, y) of the target genes only; ``n_union`` of them, a row each, which is broadcast if that is small."""
    near = broadcast_if_small(union.select("gene_id"), 32 * n_union)
    return matrix.select(*columns, F.explode("entries").alias("e")).select(*columns, "e.gene_id", "e.y").join(near, "gene_id", "left_semi")


def xty(entries: DataFrame) -> DataFrame:
    """p_idx, gene_id, s over modelled cells; p_idx 0 sums all of them. ``entries`` has is_control, active, gene_id, y."""
    rows = entries.select(F.explode(F.concat(F.array(F.lit(0)), "active")).alias("p_idx"), "gene_id", "y")
    return rows.groupBy("p_idx", "gene_id").agg(F.sum("y").alias("s"))


def cooccurrence(cells: DataFrame) -> DataFrame:
    """p1, p2, n: modelled cells with both (p1 = p2: with it), from the counts of distinct active sets."""
    sets = cells.where("is_model").groupBy("active").agg(F.count("*").alias("n"))
    pairs = sets.select("n", "active", F.explode("active").alias("p1")).select("n", "p1", F.explode("active").alias("p2"))
    return pairs.groupBy("p1", "p2").agg(F.sum("n").alias("n"))


def feature_summary(rows: DataFrame, n: int) -> DataFrame:
    """gene_id, n, s, q, mean, var of entry rows (gene_id, y); zeros are implied by ``n``."""
    sums = rows.groupBy("gene_id").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).withColumn("n", F.lit(n).cast("long"))
    return sums.select("gene_id", "n", "s", "q", mean(F.col("s"), F.col("n")).alias("mean"), variance(F.col("s"), F.col("q"), F.col("n")).alias("var"))


def cluster_background(cells: DataFrame, entries: DataFrame, union: DataFrame) -> DataFrame:
    """cluster, gene_id, b: mean control y per cluster on the full grid of clusters with controls and target genes."""
    if "cluster" not in cells.columns:
        raise ValueError("background correction needs the cells' clusters")
    counts = cells.groupBy("cluster").agg(F.count_if("is_control").alias("n_control"), F.count_if("is_model").alias("n_model"))
    lacking = sorted(r["cluster"] for r in counts.where("n_model > 0 and n_control = 0").collect())
    if lacking:
        raise ValueError(f"Background clusters without control cells: {', '.join(lacking)}")
    sums = entries.where("is_control").groupBy("cluster", "gene_id").agg(F.sum("y").alias("s"))
    # every cluster with controls, for each target gene: a grid of two short tables
    grid = union.select("gene_id").join(counts.where("n_control > 0").select("cluster", "n_control"))
    return grid.join(sums, ["cluster", "gene_id"], "left").select("cluster", "gene_id", (F.coalesce("s", F.lit(0.0)) / F.col("n_control")).alias("b"))


def cluster_counts(cells: DataFrame) -> DataFrame:
    """p_idx, cluster, n of modelled cells."""
    return cells.select("cluster", F.explode("active").alias("p_idx")).groupBy("p_idx", "cluster").agg(F.count("*").alias("n"))
