"""Target genes: Welch t and log2 fold change on the full grid, filtered and ranked per perturbation; or a supplied set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidewell.functions.expressions import log2_fold_change, mean, variance, welch_t
from guidewell.operators.stats import feature_summary


def gene_tests(sums: DataFrame, counts: DataFrame, genes: DataFrame, perturbations: DataFrame) -> DataFrame:
    """p_idx, gene_id, t, logfc for every perturbation and gene: absent sums are zeros. Perturbations are few, and dealt to each gene row."""
    control = counts.where("p_idx = 0").select(F.col("n").alias("n0"))
    grid = genes.select("gene_id").join(F.broadcast(perturbations.join(counts, "p_idx").agg(F.collect_list(F.struct("p_idx", "n")).alias("ps"))))
    grid = grid.select("gene_id", F.explode("ps").alias("p")).select("gene_id", "p.p_idx", F.col("p.n").alias("n1")).join(F.broadcast(control))
    own = sums.where("p_idx > 0").select("p_idx", "gene_id", F.col("s").alias("s1"), F.col("q").alias("q1"), F.col("lin").alias("l1"))
    base = sums.where("p_idx = 0").select("gene_id", F.col("s").alias("s0"), F.col("q").alias("q0"), F.col("lin").alias("l0"))
    full = grid.join(own, ["p_idx", "gene_id"], "left").join(base, "gene_id", "left").fillna(0.0, ["s1", "q1", "l1", "s0", "q0", "l0"])
    c = F.col
    t = welch_t(mean(c("s1"), c("n1")), variance(c("s1"), c("q1"), c("n1")), c("n1"), mean(c("s0"), c("n0")), variance(c("s0"), c("q0"), c("n0")), c("n0"))
    return full.select("p_idx", "gene_id", t.alias("t"), log2_fold_change(mean(c("l1"), c("n1")), mean(c("l0"), c("n0"))).alias("logfc"))


def passing(tests: DataFrame, threshold: float | None) -> DataFrame:
    return tests if threshold is None else tests.where(~F.isnan("logfc") & (F.abs("logfc") > F.lit(float(threshold))))


def top_genes(tests: DataFrame, k: int, absolute: bool = True) -> DataFrame:
    """``rank`` from 1 to k per perturbation by |t| (or t), NaN last, ties by gene."""
    if k < 1:
        raise ValueError("k must be at least 1")
    key = F.abs("t") if absolute else F.col("t")
    order = Window.partitionBy("p_idx").orderBy(F.isnan("t"), key.desc(), "gene_id")
    counted = tests.withColumn("passing", F.count("*").over(Window.partitionBy("p_idx")))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def welch_of_matrices(case: DataFrame, control: DataFrame, features: DataFrame, n_case: int, n_control: int) -> DataFrame:
    """gene_id, t of two sets of entry rows (gene_id, y) over ``n_case`` and ``n_control`` rows; zeros are implied, a set without rows raises."""
    if n_case < 1 or n_control < 1:
        raise ValueError("Welch's t needs rows in both groups")
    side = lambda rows, n, x: feature_summary(rows, n).select("gene_id", F.col("mean").alias(f"m{x}"), F.col("var").alias(f"v{x}"))
    both = features.select("gene_id").join(side(case, n_case, 1), "gene_id", "left").join(side(control, n_control, 0), "gene_id", "left").fillna(0.0, ["m1", "v1", "m0", "v0"])
    return both.select("gene_id", welch_t(F.col("m1"), F.col("v1"), F.lit(n_case), F.col("m0"), F.col("v0"), F.lit(n_control)).alias("t"))


def ordered_union(targets: DataFrame) -> DataFrame:
    """gene_id, position: target genes in order of first appearance over perturbations, then ranks."""
    first = targets.groupBy("gene_id").agg(F.min(F.struct("p_idx", "rank")).alias("first"))
    return first.select("gene_id", (F.row_number().over(Window.orderBy("first")) - 1).alias("position"))


def hvg_targets(genes: DataFrame, perturbations: DataFrame) -> DataFrame:
    """p_idx, gene_id, rank: the flagged genes for every perturbation, in gene order."""
    if "highly_variable" not in genes.columns:
        raise ValueError("genes have no column highly_variable")
    flagged = genes.where(F.coalesce(F.col("highly_variable").cast("boolean"), F.lit(False)))
    if flagged.isEmpty():
        raise ValueError("no gene is flagged highly_variable")
    ranked = flagged.select("gene_id", F.row_number().over(Window.orderBy("gene_id")).alias("rank"))
    return ranked.join(F.broadcast(perturbations.agg(F.collect_list("p_idx").alias("ps")))).select(F.explode("ps").alias("p_idx"), "gene_id", "rank")
