"""Library-size normalization and log1p, row by row: no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidewell.functions.expressions import total


def dense_rows(rows: DataFrame, column: str = "vector") -> DataFrame:
    """row_id, indices, values (nonzeros) of dense arrays."""
    pairs = F.filter(F.transform(F.col(column).cast("array<double>"), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] != 0)
    return rows.select("row_id", pairs.alias("p")).select("row_id", F.transform("p", lambda p: p["i"]).alias("indices"), F.transform("p", lambda p: p["v"]).alias("values"))


def faults(rows: DataFrame, n_genes: int) -> DataFrame:
    """``rows`` with fault: -4 where a row_id has several rows; -3 where indices do not match values, are repeated, null or no
    gene's, or a value is null; else 0. The window needs rows by row_id, as the join with the cells does after it."""
    bad = F.col("indices").isNull() | F.col("values").isNull() | (F.size("indices") != F.size("values")) | F.exists("indices", lambda g: g.isNull() | (g < 0) | (g >= n_genes)) | F.exists("values", lambda v: v.isNull()) | (F.size(F.array_distinct("indices")) != F.size("indices"))
    several = F.count("*").over(Window.partitionBy("row_id")) > 1
    return rows.withColumn("fault", F.when(several, -4).when(F.coalesce(bad, F.lit(True)), -3).otherwise(0))


def raise_faults(malformed: int, repeated: int) -> None:
    if malformed:
        raise ValueError(f"{malformed} expression rows with indices that do not match their values or the genes")
    if repeated:
        raise ValueError(f"{repeated} expression rows with a repeated row_id")


def check_rows(rows: DataFrame, n_genes: int) -> None:
    """Raise where :func:`faults` finds any."""
    found = faults(rows, n_genes).agg(F.count_if(F.col("fault") == -3).alias("bad"), F.count_if(F.col("fault") == -4).alias("several")).first()
    raise_faults(found["bad"], found["several"])


def library_size(rows: DataFrame) -> DataFrame:
    return rows.withColumn("total", total(F.col("values").cast("array<double>")))


def normalized(rows: DataFrame, target_sum: float, log: bool = True) -> DataFrame:
    """``rows`` with entries ARRAY<STRUCT<gene_id, z, y>>: z = x * (target_sum / total), y = log1p(z); all 0 where the total is not above 0."""
    sized = library_size(rows)
    factor = F.when(F.col("total") > 0, F.lit(float(target_sum)) / F.col("total")).otherwise(0.0)
    zipped = F.transform(F.arrays_zip("indices", "values"), lambda p: F.struct(p["indices"].alias("gene_id"), (p["values"].cast("double") * F.col("factor")).alias("z")))
    sized = sized.withColumn("factor", factor).withColumn("e", zipped)
    y = (lambda z: F.log1p(z)) if log else (lambda z: z)
    entries = F.filter(F.transform("e", lambda p: F.struct(p["gene_id"].alias("gene_id"), p["z"].alias("z"), y(p["z"]).alias("y"))), lambda p: p["z"] != 0)
    return sized.withColumn("entries", entries).drop("e", "factor", "indices", "values")


def clipped(entries: DataFrame, clip: DataFrame) -> DataFrame:
    """Entry rows (gene_id, y, ...) with y at most the gene's clip value; zeros go."""
    return entries.join(clip.select("gene_id", "clip"), "gene_id").withColumn("y", F.least("y", "clip")).drop("clip").where("y <> 0")
