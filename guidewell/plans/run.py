"""The whole run as one plan: labels, normalization, targets, clip values, ridge, scores, manifest."""

from __future__ import annotations

import math
import resource
import sys
import time
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidewell.model import Config, PerturbData, Result, broadcast_if_small
from guidewell.operators import clip as clipping
from guidewell.operators import labels, ridge, score, stats, targets
from guidewell.operators.normalize import faults, normalized, raise_faults
from guidewell.operators.output import write_output
from guidewell.sources.datasets import open_dataset


#: Fixed values of the manifest, by mode; and of clip values from histograms.
FIXED = {
    "single": {"algorithm": "ps_score_exact_fast", "input_type": "anndata-single-backed-stream"},
    "multilabel": {"algorithm": "ps_score_exact_fast_multilabel", "input_type": "anndata-multilabel-backed-stream"},
}
CLIP_METHOD = "streaming_histogram"


class _Clock:
    def __init__(self, spark: SparkSession, show: bool):
        self.spark, self.show, self.began, self.last, self.seconds = spark, show, time.perf_counter(), time.perf_counter(), {}

    def phase(self, text: str) -> None:
        self.last = time.perf_counter()
        self.spark.sparkContext.setJobDescription(text)
        if self.show:
            print(f"[guidewell] {text}", file=sys.stderr, flush=True)

    def done(self, name: str) -> None:
        self.seconds[f"{name}_seconds"] = time.perf_counter() - self.last


def check_counts(counts: dict[int, int], perturbations: list[str]) -> None:
    if not counts.get(0):
        raise ValueError("No control cells found")
    if empty := [p for i, p in enumerate(perturbations, 1) if not counts.get(i)]:
        raise ValueError(f"Selected perturbations without modelled cells: {', '.join(empty)}")


def run(
    data: PerturbData | str, *, perturb_column: str, ctrl_name: str, mode: str = "single", output_dir: str | None = None, layer: str | None = None, perturbations: Sequence[str] | None = None, target_mode: str = "union_deg",
    target_gene_max: int = 500, chunk_size: int = 8192, lr_lambda: float = 0.01, score_lambda: float = 0.0, scale_factor: float = 3.0, target_sum: float = 1e4, rank_by_abs_t: bool = True, scale_score: bool = True,
    logfc_threshold: float | None = 0.1, background_cluster_column: str | None = None, clip_quantile: float | None = None, clip_bins: int = 2048, show_progress: bool = False, spark: SparkSession | None = None,
) -> Result | dict[str, Any]:
    """Score every perturbed cell. Returns a Result of lazy tables, or with ``output_dir`` the manifest of what was written.

    Normalized rows are kept for the two or three passes over them; ``Result.release`` frees them. What reaches the driver
    has a row a perturbation, a target gene, a pair of perturbations, or, up to BROADCAST_BYTES, a perturbation and target
    gene; cells and genes of the whole matrix never do.
    """
    config = Config(mode, target_mode, target_gene_max, chunk_size, lr_lambda, score_lambda, scale_factor, target_sum, rank_by_abs_t, scale_score, logfc_threshold, clip_quantile, clip_bins)
    config.check()
    source = data
    data = open_dataset(spark or SparkSession.getActiveSession(), data) if isinstance(data, str) else data
    spark = data.cells.sparkSession
    held: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        held.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    cells, with_clusters = data.cells, background_cluster_column is not None
    if with_clusters:
        cells = labels.clean(cells, background_cluster_column, "background cluster", "cluster")
    parsed = labels.parse(cells, perturb_column, mode, ctrl_name, perturbations)
    chosen, table = parsed.perturbations, parsed.table
    clock = _Clock(spark, show_progress)

    clock.phase("target statistics")
    n_genes = (data.genes.agg(F.max("gene_id")).first()[0] or 0) + 1
    cells = parsed.cells.select("row_id", "obs_index", "label", "is_control", "is_model", "active", *["cluster"] * with_clusters)
    rows = normalized(faults(data.layer(layer), n_genes), target_sum)
    none = F.array().cast("array<struct<gene_id:int,z:double,y:double>>")
    matrix = keep(cells.join(rows.select("row_id", "entries", "fault"), "row_id", "left").withColumn("entries", F.coalesce("entries", none)))
    cells = matrix.drop("entries", "fault")
    counts = stats.census(matrix)
    total, n_model = counts.pop(-1, 0), counts.pop(-2, 0)
    raise_faults(counts.pop(-3, 0), counts.pop(-4, 0))
    check_counts(counts, chosen)
    counts_table = spark.createDataFrame(sorted(counts.items()), "p_idx int, n long")
    model = matrix.where("is_model")

    sums = None
    if target_mode == "hvg":
        ranked = targets.hvg_targets(data.genes, table).withColumn("passing", F.lit(0))
    else:
        sums = keep(stats.group_sums(model))
        tests = targets.passing(targets.gene_tests(sums, counts_table, data.genes, table), logfc_threshold)
        ranked = targets.top_genes(tests, target_gene_max, rank_by_abs_t)
    found = ranked.join(data.genes.select("gene_id", "gene_name"), "gene_id").select("p_idx", "rank", "gene_id", "passing", "gene_name").toArrow()  # target_gene_max a perturbation
    picked: dict[int, list[int]] = {}
    passed: dict[int, int] = dict(zip(found["p_idx"].to_pylist(), found["passing"].to_pylist(), strict=True))
    names: dict[int, str] = dict(zip(found["gene_id"].to_pylist(), found["gene_name"].to_pylist(), strict=True))
    found = found.select(["p_idx", "rank", "gene_id"]).sort_by([("p_idx", "ascending"), ("rank", "ascending")])
    for p, g in zip(found["p_idx"].to_pylist(), found["gene_id"].to_pylist(), strict=True):
        picked.setdefault(p, []).append(g)
    union_genes = list(dict.fromkeys(g for p in sorted(picked) for g in picked[p]))
    union = spark.createDataFrame([(g, k) for k, g in enumerate(union_genes)], "gene_id int, position int")
    clock.done("target_stats")

    clock.phase("clip values")
    clip = None
    if clip_quantile is not None:
        entries = stats.union_entries(model, union, n_union=len(union_genes))
        most = math.log1p(target_sum)
        clip = keep(clipping.histogram_quantiles(clipping.histogram(entries, clip_bins, most), union, n_model, clip_quantile, clip_bins, most))
    clock.done("clip_threshold")

    clock.phase("sufficient statistics")
    entries = stats.union_entries(model, union, *[c for c in ("is_control", "active", "cluster") if c in cells.columns], n_union=len(union_genes))
    if clip is not None:
        entries = entries.join(broadcast_if_small(clip, 64 * len(union_genes)), "gene_id").withColumn("y", F.least("y", "clip")).drop("clip")
    background = keep(stats.cluster_background(cells, entries, union)) if with_clusters else None
    clock.done("clipped_sufficient_stats")
    if mode == "single":
        if sums is not None and clip is None and background is None:
            own = sums.join(broadcast_if_small(union.select("gene_id"), 32 * len(union_genes)), "gene_id", "left_semi").select("p_idx", "gene_id", "s")
        else:
            groups = F.when(F.col("is_control"), F.array(F.lit(0))).otherwise(F.col("active"))
            own = entries.select(F.explode(groups).alias("p_idx"), "gene_id", "y").groupBy("p_idx", "gene_id").agg(F.sum("y").alias("s"))
        clock.done("ridge_sufficient_stats")
        clock.phase("ridge")
        if background is None:
            beta = ridge.single_label(own, counts_table, union, table, lr_lambda)
        else:
            beta = ridge.single_label_background(own, counts_table, stats.cluster_counts(cells.where("is_model")), background, union, table, lr_lambda)
    else:
        right = stats.xty(entries)
        both = stats.cooccurrence(cells)
        clock.done("ridge_sufficient_stats")
        clock.phase("ridge")
        if background is not None:
            expected = stats.cluster_counts(cells.where("is_model")).join(background, "cluster").groupBy("p_idx", "gene_id").agg((-F.sum(F.col("n") * F.col("b"))).alias("s"))
            right = right.where("p_idx > 0").unionByName(expected).groupBy("p_idx", "gene_id").agg(F.sum("s").alias("s"))
        beta = ridge.multilabel(right, both, n_model, len(chosen), union, lr_lambda, background is not None)
    beta = keep(beta)
    near = score.near_effects(beta, background, clip, union_genes, len(chosen))
    if near is None:
        norms = {r["p_idx"]: r["norm"] for r in ridge.norms(beta).collect()}
    else:
        norms = dict(enumerate(np.einsum("ij,ij->i", near.effect, near.effect).tolist(), 1))
    clock.done("ridge_solve")

    clock.phase("scores")
    if near is not None:
        scores = score.scored_cells(matrix, near, mode == "single", score_lambda, scale_factor)
    else:
        norm_table = spark.createDataFrame([(i, float(norms.get(i, 0.0))) for i in range(1, len(chosen) + 1)], "p_idx int, norm double")
        base = ridge.baseline(beta) if background is None else ridge.background_projection(beta, background)
        ready = score.rhs(score.exchanged_projections(matrix, beta, union, clip), norm_table, base)
        if mode == "single":
            scores = score.single_scores(ready, score_lambda, scale_factor)
        else:
            scores = score.multilabel_scores(ready, score.grams(cells, beta), score_lambda, scale_factor)
    scores = keep(scores)
    tops = scores.groupBy("p_idx").agg(F.max("whole").alias("raw_max"), F.count("*").alias("n"), F.count_if("first").alias("cells")).collect()
    top = {r["p_idx"]: r["raw_max"] for r in tops}
    n_scored, n_valid = sum(r["n"] for r in tops), sum(r["cells"] for r in tops)
    most = broadcast_if_small(spark.createDataFrame(sorted(top.items()), "p_idx int, raw_max double"), 32 * len(top))
    scores = score.scaled(scores, most, scale_score)
    clock.done("scoring")

    meta: dict[str, Any] = {}
    for i, p in enumerate(chosen, 1):
        genes = picked.get(i, [])
        meta[p] = {"cell_count": counts.get(i, 0), "selected_gene_count": len(genes), "selected_genes": [names.get(g) for g in genes]}
        if target_mode == "union_deg" and logfc_threshold is not None:
            meta[p]["logfc_filtered_gene_count"] = passed.get(i, 0)
        meta[p] |= {"beta_norm_sq": float(norms.get(i, 0.0)), "max_score_before_column_scale": float(top.get(i, 0.0)), "column_scaled": bool(scale_score)}
    detail = {"mode": "hvg", "var_column": "highly_variable"} if target_mode == "hvg" else {"mode": "union_deg", "rank_by_abs_t": bool(rank_by_abs_t), "logfc_threshold": logfc_threshold, "logfc_base": 2, "logfc_pseudocount": 1.0}
    clipping_on = clip_quantile is not None
    manifest = {
        **FIXED[mode], "mode": mode, "layer": layer, "perturb_column": perturb_column, "control_label": ctrl_name, "target_mode": target_mode,
        "target_gene_source": target_mode, "target_gene_source_detail": detail, "target_gene_max": target_gene_max, "rank_by_abs_t": bool(rank_by_abs_t), "logfc_threshold": logfc_threshold,
        "background_correction": background is not None, "background_cluster_column": background_cluster_column, "quantile_clip": clipping_on, "clip_quantile": clip_quantile,
        "clip_method": CLIP_METHOD if clipping_on else None, "clip_bins": clip_bins if clipping_on else None, "chunk_size": chunk_size, "target_sum": target_sum, "lr_lambda": lr_lambda, "score_lambda": score_lambda,
        "scale_factor": scale_factor, "scale_score": bool(scale_score), "selected_perturbations": chosen, "control_cell_count": counts[0], "perturbation_cell_counts": {p: counts.get(i, 0) for i, p in enumerate(chosen, 1)},
        "union_target_gene_count": len(union_genes), "union_target_genes": [names.get(g) for g in union_genes], "target_gene_metadata": meta, "beta_shape": [len(chosen) + 1, len(union_genes)], "valid_scored_cell_count": n_valid,
    }
    if background is not None:
        n = {r["cluster"]: r["n"] for r in cells.where("is_control").groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        manifest |= {"background_cluster_count": cells.select("cluster").distinct().count(), "background_control_cell_counts": n}
    if mode == "single":
        manifest["score_vector_shape"] = [total, 1]
    else:
        manifest |= {"guide_multiplicity": labels.multiplicity(cells).first().asDict(), "scored_pair_count": n_scored}
    manifest |= {"timings": {**clock.seconds, "total_seconds": time.perf_counter() - clock.began}, "max_rss_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}
    result = Result(scores, score.long_table(cells, scores, table, ctrl_name), beta, chosen, union_genes, manifest, held)
    spark.sparkContext.setJobDescription(None)
    if output_dir is None:
        return result
    try:
        return write_output(result, output_dir, dataset_path=source if isinstance(source, str) else None)
    finally:
        result.release()


def scores_frame(*args, **kwargs) -> DataFrame:
    """row_id, perturbation, score of scored rows."""
    out = run(*args, **kwargs)
    table = out.scores.sparkSession.createDataFrame(list(enumerate(out.perturbations, 1)), "p_idx int, perturbation string")
    return out.scores.join(F.broadcast(table), "p_idx").select("row_id", "perturbation", "score")
