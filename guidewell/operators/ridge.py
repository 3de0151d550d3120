"""Ridge regression of target genes on perturbations, as beta(p_idx, gene_id, b) with p_idx 0 the intercept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidewell.functions.linear import conjugate_gradients, solve_from_gram
from guidewell.model import BROADCAST_BYTES

#: Systems of at most so many perturbations are inverted whole (32 MB); larger ones stay sparse.
DENSE = 2000


def target_grid(union: DataFrame, perturbations: DataFrame) -> DataFrame:
    return union.select("gene_id").join(perturbations.select("p_idx"))


def single_label(sums: DataFrame, counts: DataFrame, union: DataFrame, perturbations: DataFrame, lr_lambda: float) -> DataFrame:
    """Closed form: the system is an arrow (intercept, then one column a perturbation), so the intercept is eliminated per gene.

    ``sums``: s per (p_idx, gene_id), p_idx 0 the controls. The intercept is penalized too.
    """
    lam = F.lit(float(lr_lambda))
    grid = target_grid(union, perturbations).join(counts.where("p_idx > 0"), "p_idx").join(sums.where("p_idx > 0").select("p_idx", "gene_id", "s"), ["p_idx", "gene_id"], "left").fillna(0.0, ["s"])
    n0 = F.broadcast(counts.agg(F.sum("n").alias("n_model")))
    control = sums.where("p_idx = 0").select("gene_id", F.col("s").alias("s0"))
    shrink = F.col("n") / (F.col("n") + lam)
    whole = grid.groupBy("gene_id").agg(F.sum("s").alias("sp"), F.sum(shrink * F.col("s")).alias("explained"), F.sum(shrink * F.col("n")).alias("used"))
    whole = whole.join(control, "gene_id", "left").fillna(0.0, ["s0"]).join(n0)
    zero = whole.select("gene_id", ((F.col("s0") + F.col("sp") - F.col("explained")) / (F.col("n_model") + lam - F.col("used"))).alias("b0"))
    rest = grid.join(zero, "gene_id").select("p_idx", "gene_id", ((F.col("s") - F.col("n") * F.col("b0")) / (F.col("n") + lam)).alias("b"))
    return rest.unionByName(zero.select(F.lit(0).alias("p_idx"), "gene_id", F.col("b0").alias("b")))


def single_label_background(sums: DataFrame, counts: DataFrame, cluster_counts: DataFrame, background: DataFrame, union: DataFrame, perturbations: DataFrame, lr_lambda: float) -> DataFrame:
    """Without intercept, against each cluster's control mean: (s - sum_k n_k b_k) / (n + lambda)."""
    expected = cluster_counts.join(background, "cluster").groupBy("p_idx", "gene_id").agg(F.sum(F.col("n") * F.col("b")).alias("expected"))
    grid = target_grid(union, perturbations).join(counts.where("p_idx > 0"), "p_idx").join(sums.where("p_idx > 0").select("p_idx", "gene_id", "s"), ["p_idx", "gene_id"], "left").join(expected, ["p_idx", "gene_id"], "left").fillna(0.0, ["s", "expected"])
    rest = grid.select("p_idx", "gene_id", ((F.col("s") - F.col("expected")) / (F.col("n") + F.lit(float(lr_lambda)))).alias("b"))
    return rest.unionByName(union.select(F.lit(0).alias("p_idx"), "gene_id", F.lit(0.0).alias("b")))


def multilabel(xty: DataFrame, cooccurrence: DataFrame, n_model: int, n_perturbations: int, union: DataFrame, lr_lambda: float, corrected: bool = False, dense: int | None = None) -> DataFrame:
    """General solve, by blocks of genes. The system of all perturbations is the same for each gene; what reaches the driver is its entries that are not 0.

    Up to ``dense`` perturbations it is inverted once and the inverse applied to each block; beyond, the sparse system is
    sent and each block solved by conjugate gradients. ``xty``: s per (p_idx, gene_id), p_idx 0 over all modelled cells
    (absent when ``corrected``: then there is no intercept).
    """
    p = n_perturbations
    found = cooccurrence.toPandas()
    p1, p2, n = (found[c].to_numpy(np.int64) for c in ("p1", "p2", "n"))
    own = p1 == p2
    row, column = np.concatenate([p1, p1[own], np.zeros(own.sum(), np.int64), np.arange(p + 1)]), np.concatenate([p2, np.zeros(own.sum(), np.int64), p1[own], np.arange(p + 1)])
    value = np.concatenate([n, n[own], n[own], np.full(p + 1, float(lr_lambda))]).astype(float)
    value[len(p1) + 2 * own.sum()] += n_model
    if corrected:  # the intercept is held at 0
        there = (row > 0) & (column > 0)
        row, column, value = np.append(row[there], 0), np.append(column[there], 0), np.append(value[there], 1.0)
    if p <= (DENSE if dense is None else dense):
        gram = np.zeros((p + 1, p + 1))
        np.add.at(gram, (row, column), value)
        system = (solve_from_gram(gram, np.eye(p + 1), 0.0),)
    else:
        order = np.lexsort((column, row))
        system = row[order], column[order], value[order]
        if sum(a.nbytes for a in system) > 4 * BROADCAST_BYTES:
            raise ValueError(f"{len(row)} pairs of perturbations in one cell are too many for one system")
    sent = xty.sparkSession.sparkContext.broadcast(system)

    def apply(pdf):
        import pandas as pd

        genes = np.sort(pdf["gene_id"].unique())
        rhs = np.zeros((p + 1, len(genes)))
        there = pdf[pdf["p_idx"] >= int(corrected)]
        rhs[there["p_idx"].to_numpy(), np.searchsorted(genes, there["gene_id"].to_numpy())] = there["s"].to_numpy()
        b = sent.value[0] @ rhs if len(sent.value) == 1 else conjugate_gradients(*sent.value, rhs)
        return pd.DataFrame({"p_idx": np.repeat(np.arange(p + 1, dtype=np.int32), len(genes)), "gene_id": np.tile(genes, p + 1).astype(np.int32), "b": b.ravel()})

    marks = union.select(F.lit(-1).alias("p_idx"), "gene_id", F.lit(0.0).alias("s"))  # every target gene has a row
    rows = xty.select("p_idx", F.col("gene_id").cast("int").alias("gene_id"), "s").unionByName(marks)
    return rows.groupBy(F.floor(F.col("gene_id") / 64).alias("block")).applyInPandas(apply, "p_idx int, gene_id int, b double")


def norms(beta: DataFrame) -> DataFrame:
    return beta.where("p_idx > 0").groupBy("p_idx").agg(F.sum(F.col("b") * F.col("b")).alias("norm"))


def baseline(beta: DataFrame) -> DataFrame:
    """p_idx, base: intercept times each perturbation's effect."""
    zero = beta.where("p_idx = 0").select("gene_id", F.col("b").alias("b0"))
    return beta.where("p_idx > 0").join(zero, "gene_id").groupBy("p_idx").agg(F.sum(F.col("b") * F.col("b0")).alias("base"))


def background_projection(beta: DataFrame, background: DataFrame) -> DataFrame:
    """p_idx, cluster, base."""
    joined = beta.where("p_idx > 0").join(background.withColumnRenamed("b", "bg"), "gene_id")
    return joined.groupBy("p_idx", "cluster").agg(F.sum(F.col("b") * F.col("bg")).alias("base"))
