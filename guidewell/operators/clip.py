"""Clip values: quantiles of each gene from a sparse histogram of its nonzero values, implied zeros included."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidewell.functions.expressions import histogram_bin
from guidewell.operators.normalize import clipped


def histogram(entries: DataFrame, bins: int, most: float) -> DataFrame:
    """gene_id, bin, n of positive values; only bins that hold something."""
    return entries.where("y > 0").groupBy("gene_id", histogram_bin(F.col("y"), bins, most).alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantiles(hist: DataFrame, genes: DataFrame, n_cells: int, quantile: float, bins: int, most: float) -> DataFrame:
    """gene_id, clip for every gene: linear between the values at the two ranks; a rank among the zeros is 0, else its bin's upper edge."""
    if n_cells <= 0:
        raise ValueError("no modelled cells to take quantiles of")
    if not 0 < quantile <= 1 or bins < 2:
        raise ValueError("a quantile in (0, 1] and at least 2 bins are needed")
    at = (n_cells - 1) * quantile
    low, high = math.floor(at), math.ceil(at)
    total = F.sum("n").over(Window.partitionBy("gene_id"))
    running = F.sum("n").over(Window.partitionBy("gene_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    seen = hist.withColumn("zeros", F.lit(n_cells) - total).withColumn("cum", running)
    edge = (F.col("bin") + 1) * F.lit(most / bins)
    at_rank = lambda rank: F.coalesce(F.max(F.when(F.lit(rank) < F.col("zeros"), 0.0)), F.min(F.when(F.col("cum") >= F.lit(rank) - F.col("zeros") + 1, edge)), F.lit(float(most)))
    found = seen.groupBy("gene_id").agg(at_rank(low).alias("a"), at_rank(high).alias("b"))
    return genes.select("gene_id").join(found, "gene_id", "left").select("gene_id", F.coalesce(F.col("a") + (F.col("b") - F.col("a")) * F.lit(at - low), F.lit(0.0)).alias("clip"))


def exact_quantiles(entries: DataFrame, genes: DataFrame, n_cells: int, quantile: float) -> DataFrame:
    """gene_id, clip: exact quantiles with implied zeros, by rank among the nonzero values (negative ones come before the zeros)."""
    at = (n_cells - 1) * quantile
    low, high = math.floor(at), math.ceil(at)
    ranked = entries.where("y <> 0").withColumn("k", F.row_number().over(Window.partitionBy("gene_id").orderBy("y")) - 1)
    per = Window.partitionBy("gene_id")
    ranked = ranked.withColumn("zeros", F.lit(n_cells) - F.count("*").over(per)).withColumn("rank", F.col("k") + F.when(F.col("y") > 0, F.col("zeros")).otherwise(0))
    found = ranked.groupBy("gene_id").agg(*[F.coalesce(F.max(F.when(F.col("rank") == r, F.col("y"))), F.lit(0.0)).alias(n) for r, n in ((low, "a"), (high, "b"))])
    return genes.select("gene_id").join(found, "gene_id", "left").select("gene_id", F.coalesce(F.col("a") + (F.col("b") - F.col("a")) * F.lit(at - low), F.lit(0.0)).alias("clip"))


def clip_exactly(entries: DataFrame, genes: DataFrame, n_cells: int, quantile: float) -> DataFrame:
    """``entries`` (gene_id, y, ...) with y at most the gene's exact quantile; entries that become 0 go."""
    return clipped(entries, exact_quantiles(entries, genes, n_cells, quantile))
