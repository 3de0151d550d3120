"""Words of Arrow text columns as codes, and labelled examples of a bounded, documented number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Text is handled in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def coded(texts: pa.Array, lower: str | None = None, slice_bytes: int = SLICE_BYTES):
    """Yield (lo, hi, words, codes, starts) for slices of a text column: the slice's distinct words (split at the six
    white-space characters), the code of each word in turn, and where each text's words start (one more at the end).
    ``lower``: "ascii" or "utf8". Null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // slice_bytes
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = texts.slice(a, b - a)
        if lower:
            part = pc.ascii_lower(part) if lower == "ascii" else pc.utf8_lower(part)
        lists = pc.ascii_split_whitespace(part)
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(lists)
        if pc.any(pc.equal(flat, "")).as_py():  # at the ends of a text
            real = pc.not_equal(flat, "")
            owner = np.repeat(np.arange(b - a), per)[real.to_numpy(zero_copy_only=False)]
            per, flat = np.bincount(owner, minlength=b - a), flat.filter(real)
        d = flat.dictionary_encode()
        yield a, b, d.dictionary.to_pylist(), d.indices.to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(per)))


def owners(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def examples(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled training texts of either class, by hash of their id, with all classes' totals.

    Training rows are those whose crc32(doc_id as text) mod ``folds`` is not 0. Ids with a null label, or both labels, are
    left out, and so are texts whose copies have both. The ids are a bounded table (``per_class`` of 8 bytes a class), so the texts are found without an exchange.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc_fold("doc_id", folds) != 0).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "y").collect()]
    # from Arrow: rows of Python would pass through workers of another kind, which stay beside those of the operators
    ids = pa.table({"ex_id": pa.array([r["doc_id"] for r in chosen], pa.int64()), "y": pa.array([r["y"] for r in chosen], pa.int32())})
    ids = docs.sparkSession.createDataFrame(ids)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("ex_id"))
    # copies of one text are one example: they would pass for independent evidence
    one = found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    return one.select("doc_id", "text", "y"), totals


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic_line(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and offset, on the logit scale, of the likeliest line from votes to labels, held near slope 1; (1, 0) for one class."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    w, line = weight / weight.mean(), np.array([1.0, 0.0])
    design = np.stack([logit(votes), np.ones(len(y))], axis=1)
    for _ in range(rounds):  # Newton's steps
        p = 1 / (1 + np.exp(-design @ line))
        gradient = design.T @ (w * (y - p)) - 0.1 * (line - [1.0, 0.0])
        line = line + np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + 0.1 * np.eye(2), gradient).clip(-1, 1)
    return (float(line[0]), float(line[1])) if np.isfinite(line).all() and line[0] > 0 else (1.0, 0.0)
