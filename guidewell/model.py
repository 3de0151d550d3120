"""The data model: cells, genes and sparse expression rows as DataFrames, and the parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: cells: row_id LONG, obs_index STRING and any per-cell attributes; genes: gene_id INT, gene_name STRING, optionally
#: highly_variable BOOLEAN; expr: row_id LONG, indices ARRAY<INT>, values ARRAY<DOUBLE> (nonzeros), optionally layer STRING.
#: Tables or arrays of at most so many bytes are broadcast; what is larger is joined by exchange.
BROADCAST_BYTES = 128 << 20


def broadcast_if_small(table: DataFrame, n_bytes: int) -> DataFrame:
    """Broadcast a table whose size is known to be within the limit; else leave the join to the optimizer."""
    return F.broadcast(table) if n_bytes <= BROADCAST_BYTES else table


@dataclass(frozen=True)
class PerturbData:
    """One data set. ``row_id`` and ``gene_id`` are positions supplied by the source; a cell without expression has no row in ``expr``."""

    cells: DataFrame
    genes: DataFrame
    expr: DataFrame

    def layer(self, name: str | None) -> DataFrame:
        """Expression rows of a layer; without a name, of the main matrix (all rows where there is no layer column)."""
        if "layer" not in self.expr.columns:
            if name is not None:
                raise KeyError(name)
            return self.expr
        rows = self.expr.where(self.expr["layer"].isNull() if name is None else self.expr["layer"] == name)
        if name is not None and rows.isEmpty():
            raise KeyError(name)
        return rows.drop("layer")


@dataclass(frozen=True)
class Config:
    mode: str = "single"
    target_mode: str = "union_deg"
    target_gene_max: int = 500
    chunk_size: int = 8192
    lr_lambda: float = 0.01
    score_lambda: float = 0.0
    scale_factor: float = 3.0
    target_sum: float = 1e4
    rank_by_abs_t: bool = True
    scale_score: bool = True
    logfc_threshold: float | None = 0.1
    clip_quantile: float | None = None
    clip_bins: int = 2048

    def check(self) -> None:
        assert self.clip_quantile is None or 0 < self.clip_quantile <= 1, "clip_quantile must be in (0, 1]"
        assert isinstance(self.clip_bins, int) and self.clip_bins >= 2, "clip_bins must be an integer of at least 2"
        if self.logfc_threshold is not None and self.logfc_threshold < 0:
            raise ValueError("logfc_threshold must be >= 0")
        if self.target_mode not in ("union_deg", "hvg"):
            raise ValueError(f"unknown target_mode {self.target_mode!r}")
        if self.mode not in ("single", "multilabel"):
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass
class Result:
    """Lazy tables of a run: ``table`` is the long output with row_id and p_idx, ``scores`` its scored rows. ``release`` frees what is kept for them."""

    scores: DataFrame
    table: DataFrame
    beta: DataFrame
    perturbations: list[str]
    union_genes: list[int]
    metadata: dict[str, Any] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def output(self) -> DataFrame:
        return self.table.orderBy("row_id", "p_idx").select("obs_index", "ps_score", "perturbation")

    def release(self) -> None:
        """Drop kept tables from memory and disk; the lazy tables stay usable and are computed again."""
        while self.held:
            self.held.pop().unpersist()
