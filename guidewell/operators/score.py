"""Scores: each cell projected on the effects of its own perturbations, within bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guidewell import model
from guidewell.functions.expressions import bounded
from guidewell.functions.quadratic import solve

SCORED = "row_id long, obs_index string, p_idx int, s float, whole double, first boolean"


@dataclass
class Effects:
    """All effects as one array, for scoring cells where they are: broadcast, so only made when it is small."""

    genes: np.ndarray  # target genes, ascending
    effect: np.ndarray  # perturbations x genes
    base: np.ndarray  # clusters x perturbations: what the baseline adds to a projection; one row without clusters
    clip: np.ndarray | None = None
    clusters: dict[str, int] = field(default_factory=dict)

    def projections(self, batch, k: int) -> np.ndarray:
        """Projection of each cell of an Arrow batch on each of its first ``k`` perturbations, less the baseline's; 0 where it has fewer."""
        entries, active = batch.column("entries"), batch.column("active")
        n = batch.num_rows
        flat = entries.flatten()
        gene, y = flat.field("gene_id").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), entries.value_lengths().to_numpy(zero_copy_only=False))
        out = np.zeros((n, k))
        if len(self.genes):
            at = np.minimum(np.searchsorted(self.genes, gene), len(self.genes) - 1)
            hit = self.genes[at] == gene
            at, y, owner = at[hit], y[hit], owner[hit]
            if self.clip is not None:
                y = np.minimum(y, self.clip[at])
        else:
            at, y, owner = np.zeros(0, int), y[:0], owner[:0]
        own = np.zeros(n, int)
        if self.clusters:
            own = np.array([self.clusters.get(c, -1) for c in batch.column("cluster").to_pylist()], int)
        for j, p in enumerate(self.columns(active, k).T):
            there = p > 0
            dot = np.bincount(owner, weights=y * self.effect[np.maximum(p, 1)[owner] - 1, at], minlength=n) if len(at) else np.zeros(n)
            out[:, j] = np.where(there, dot - self.base[own, np.maximum(p, 1) - 1], 0.0)
        return out

    @staticmethod
    def columns(active, k: int) -> np.ndarray:
        """The first ``k`` perturbations of each cell, 0 where it has fewer."""
        n = active.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(n), k), np.int64)
        out[np.arange(k) < n[:, None]] = active.flatten().to_numpy(zero_copy_only=False)
        return out


def near_effects(beta: DataFrame, background: DataFrame | None, clip: DataFrame | None, union_genes: list[int], n_perturbations: int) -> Effects | None:
    """All effects on the driver, where they are few enough to broadcast: else None, and scoring joins them by exchange."""
    genes = np.array(sorted(union_genes), np.int64)
    if 8 * len(genes) * (n_perturbations + 1) > model.BROADCAST_BYTES:
        return None
    if background is not None:
        names = sorted(r["cluster"] for r in background.select("cluster").distinct().collect())
        if 8 * len(names) * (len(genes) + n_perturbations) > model.BROADCAST_BYTES:
            return None
    place = lambda column: np.searchsorted(genes, column.to_numpy())
    found = beta.toArrow()
    b = np.zeros((n_perturbations + 1, len(genes)))
    b[found["p_idx"].to_numpy(), place(found["gene_id"])] = found["b"].to_numpy()
    made = Effects(genes, b[1:], (b[1:] @ b[0])[None, :])
    if clip is not None:
        found = clip.toArrow()
        made.clip = np.zeros(len(genes))
        made.clip[place(found["gene_id"])] = found["clip"].to_numpy()
    if background is not None:
        found, made.clusters = background.toArrow(), {c: i for i, c in enumerate(names)}
        means = np.zeros((len(names) + 1, len(genes)))  # the last row: clusters without controls, which no modelled cell is in
        means[np.array([made.clusters[c] for c in found["cluster"].to_pylist()], int), place(found["gene_id"])] = found["b"].to_numpy()
        made.base = means @ made.effect.T
    return made


def scored_cells(matrix: DataFrame, effects: Effects, single: bool, score_lambda: float, scale_factor: float) -> DataFrame:
    """SCORED rows of perturbed cells in one pass without an exchange: ``whole`` before narrowing, ``first`` once a cell.

    Single mode leaves out perturbations without an effect; else these score 0. Cells of one perturbation are scored in
    closed form, those of several by quadratic programs, all cells of a batch with the same active set together.
    """
    import pyarrow as pa

    kept = [c for c in ("row_id", "obs_index", "cluster") if c in matrix.columns]
    rows = matrix.where("not is_control and is_model").select(*kept, "active", "entries")
    sent = matrix.sparkSession.sparkContext.broadcast(effects)

    def of(batches):
        own = sent.value
        norm = np.einsum("ij,ij->i", own.effect, own.effect)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("active").value_lengths().to_numpy(zero_copy_only=False)
            k = int(n.max())
            r, p = own.projections(batch, k), own.columns(batch.column("active"), k)
            size = norm[np.maximum(p, 1) - 1]
            whole = np.where(size > 0, np.clip((r - score_lambda) / np.where(size > 0, size, 1.0), 0, scale_factor) / scale_factor, 0.0)
            if (n > 1).any():
                sets, back = np.unique(p[n > 1], axis=0, return_inverse=True)
                at = np.flatnonzero(n > 1)
                for i, members in enumerate(sets):
                    cells, active = at[back.ravel() == i], members[members > 0] - 1
                    b = own.effect[active]
                    whole[cells, : len(active)] = solve(b @ b.T, r[cells, : len(active)], score_lambda, scale_factor) / scale_factor
            row, j = np.nonzero((p > 0) & ((size > 0) | (not single)))
            s = whole[row, j].astype(np.float32)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(take), batch.column("obs_index").take(take), pa.array(p[row, j], pa.int32()), pa.array(s), pa.array(whole[row, j] if single else s.astype(float)), pa.array(np.diff(row, prepend=-1) > 0)],
                ["row_id", "obs_index", "p_idx", "s", "whole", "first"],
            )

    return rows.mapInArrow(of, SCORED)


def exchanged_projections(matrix: DataFrame, beta: DataFrame, union: DataFrame, clip: DataFrame | None) -> DataFrame:
    """row_id, obs_index, cluster?, active, p_idx, dot per perturbed cell and active perturbation, where the effects are too many to broadcast:
    entries meet the effects by (perturbation, gene) and are summed by cell."""
    kept = [c for c in ("row_id", "obs_index", "cluster") if c in matrix.columns]
    rows = matrix.where("not is_control and is_model")
    entries = rows.select("row_id", "active", F.explode("entries").alias("e")).select("row_id", "active", "e.gene_id", "e.y").join(union.select("gene_id"), "gene_id", "left_semi")
    if clip is not None:
        entries = entries.join(clip.select("gene_id", "clip"), "gene_id").withColumn("y", F.least("y", "clip"))
    dots = entries.select("row_id", "gene_id", "y", F.explode("active").alias("p_idx")).join(beta.where("p_idx > 0"), ["p_idx", "gene_id"])
    dots = dots.groupBy("row_id", "p_idx").agg(F.sum(F.col("y") * F.col("b")).alias("dot"))
    pairs = rows.select(*kept, "active", F.explode("active").alias("p_idx"))
    return pairs.join(dots, ["row_id", "p_idx"], "left").fillna(0.0, ["dot"]).select(*kept, "active", "p_idx", "dot")


def rhs(dots: DataFrame, norms: DataFrame, base: DataFrame) -> DataFrame:
    """dots with r = dot - base and the squared norm of the effect; both tables have a row a perturbation (and cluster)."""
    on = [c for c in ("p_idx", "cluster") if c in base.columns]
    out = dots.join(base, on, "left").join(norms, "p_idx", "left")
    return out.fillna(0.0, ["base", "norm"]).withColumn("r", F.col("dot") - F.col("base"))


def single_scores(rows: DataFrame, score_lambda: float, scale_factor: float) -> DataFrame:
    """SCORED rows of an effect that is not 0."""
    raw = (F.col("r") - F.lit(float(score_lambda))) / F.col("norm")
    whole = F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(scale_factor))) / F.lit(float(scale_factor))
    return rows.where("norm > 0").select("row_id", "obs_index", "p_idx", bounded(raw, scale_factor).alias("s"), whole.alias("whole"), F.lit(True).alias("first"))


def multilabel_scores(rows: DataFrame, gram: DataFrame, score_lambda: float, scale_factor: float) -> DataFrame:
    """SCORED rows: cells with one perturbation by expression, others by quadratic programs, batched by active set as they come: no group is gathered."""
    raw = (F.col("r") - F.lit(float(score_lambda))) / F.nullif(F.col("norm"), F.lit(0.0))
    one = rows.where(F.size("active") == 1).select("row_id", "obs_index", "p_idx", F.when(F.col("norm") > 0, bounded(raw, scale_factor)).otherwise(F.lit(0.0).cast("float")).alias("s"))
    many = rows.where(F.size("active") > 1).groupBy("row_id", "obs_index", "active").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "r"))), lambda x: x["r"]).alias("r"))
    many = many.join(gram, "active")

    def programs(batches):
        import pandas as pd

        for pdf in batches:
            for active, group in pdf.groupby(pdf["active"].map(tuple), sort=False):
                k = len(active)
                s = solve(np.asarray(group["gram"].iloc[0], float).reshape(k, k), np.stack(group["r"].to_numpy()), score_lambda, scale_factor) / scale_factor
                yield pd.DataFrame({"row_id": np.repeat(group["row_id"].to_numpy(), k), "obs_index": np.repeat(group["obs_index"].to_numpy(), k), "p_idx": np.tile(np.array(active, np.int32), len(group)), "s": s.ravel().astype(np.float32)})

    solved = many.mapInPandas(programs, "row_id long, obs_index string, p_idx int, s float")
    return one.unionByName(solved).select("row_id", "obs_index", "p_idx", "s", F.col("s").cast("double").alias("whole"), (F.col("p_idx") == F.min("p_idx").over(Window.partitionBy("row_id"))).alias("first"))


def grams(cells: DataFrame, beta: DataFrame) -> DataFrame:
    """active, gram (row by row): products of the effects of each active set of two or more that occurs."""
    sets = cells.where(F.col("is_model") & (F.size("active") > 1)).select("active").distinct()
    pairs = sets.select("active", F.posexplode("active").alias("i", "p1")).select("active", "i", "p1", F.posexplode("active").alias("j", "p2"))
    wanted = pairs.select(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).distinct()
    b = beta.where("p_idx > 0")
    products = wanted.join(b.select(F.col("p_idx").alias("p1"), "gene_id", F.col("b").alias("b1")), "p1").join(b.select(F.col("p_idx").alias("p2"), "gene_id", F.col("b").alias("b2")), ["p2", "gene_id"])
    products = products.groupBy("p1", "p2").agg(F.sum(F.col("b1") * F.col("b2")).alias("g"))
    full = pairs.withColumns({"lo": F.least("p1", "p2"), "hi": F.greatest("p1", "p2")}).join(products.select(F.col("p1").alias("lo"), F.col("p2").alias("hi"), "g"), ["lo", "hi"], "left").fillna(0.0, ["g"])
    return full.groupBy("active").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "g"))), lambda x: x["g"]).alias("gram"))


def scaled(rows: DataFrame, most: DataFrame, scale_score: bool) -> DataFrame:
    """score and raw_max per row, from each perturbation's largest ``raw_max``; scaling divides by it in single precision, 0 where it is 0."""
    out = rows.join(most, "p_idx")
    if scale_score:
        top = F.col("raw_max").cast("float")
        out = out.withColumn("s", F.when(top > 0, (F.col("s") / top).cast("float")).otherwise(F.lit(0.0).cast("float")))
    return out.select("row_id", "obs_index", "p_idx", F.col("s").alias("score"), "raw_max")


def long_table(cells: DataFrame, scores: DataFrame, perturbations: DataFrame, control: str) -> DataFrame:
    """row_id, p_idx, obs_index, ps_score, perturbation: scored rows, controls with 0, and the rest with nulls (p_idx -1)."""
    scored = scores.join(perturbations, "p_idx").select("row_id", "p_idx", "obs_index", F.col("score").cast("double").alias("ps_score"), "perturbation")
    plain = cells.where("is_control").select("row_id", F.lit(-1).alias("p_idx"), "obs_index", F.lit(0.0).alias("ps_score"), F.lit(control).alias("perturbation"))
    rest = cells.where("not is_control").join(scores.select("row_id").distinct(), "row_id", "left_anti")
    rest = rest.select("row_id", F.lit(-1).alias("p_idx"), "obs_index", F.lit(None).cast("double").alias("ps_score"), F.lit(None).cast("string").alias("perturbation"))
    return scored.unionByName(plain).unionByName(rest)
