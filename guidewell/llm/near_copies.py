"""Near copies by exact Jaccard similarity of word shingles: min-hash bands make groups, whole sets decide within them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, file_system, make_dirs, near_or_exchanged, new_path, opaque, remove, thrifty
from .features import coded, owners
from .language_model import _mix, word_hashes

U = np.uint64


def _shingles(words, codes, starts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in turn (of all words in a shorter text), text after text; where each text's start; and a hash of all words of each."""
    from xxhash import xxh64_intdigest

    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, U)
    n, owner = np.diff(starts), owners(starts)
    made = np.zeros(max(0, len(h) - size + 1), U)
    for j in range(size):
        made = _mix(made * U(0x9E3779B97F4A7C15) + h[j : j + len(made)])
    flat = made[np.arange(len(made)) + size <= starts[owner[: len(made)] + 1]]
    key = np.fromiter((xxh64_intdigest(h[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)), U, len(n))
    count = np.maximum(n - size + 1, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    flat = np.insert(flat, np.cumsum(count)[short], key[short])
    count[short] = 1
    return flat, np.concatenate(([0], np.cumsum(count))), key.view(np.int64)


def band_marks(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, bands): a hash of all words, and of each of ``bands`` groups of ``rows`` min-hashes; texts without words are left out."""
    import pyarrow as pa

    rng = np.random.default_rng(20)
    turn, add = (rng.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1) for _ in range(2))

    def of(batches):
        for batch in batches:
            for lo, hi, words, codes, starts in coded(batch.column(1), "ascii"):
                flat, at, key = _shingles(words, codes, starts, size)
                own = np.flatnonzero(np.diff(at))
                if not len(own):
                    continue
                made = np.zeros((len(own), bands), U)
                for j in range(bands * rows):
                    made[:, j // rows] = _mix(made[:, j // rows] * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * turn[j] + add[j], at[own]) + U(j))
                lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * bands, pa.array(made.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(own)), pa.array(key[own]), lists], ["doc_id", "key", "bands"])

    return docs.mapInArrow(thrifty(of), "doc_id long, key long, bands array<long>")


def write_sets(docs: DataFrame, size: int, base: str) -> DataFrame:
    """(key, part, attempt, start, n): where the distinct shingle hashes of each text lie, ascending, in one file a task below
    ``base``. Only what the table names counts, so a task that is run again does no harm."""
    import pyarrow as pa

    def of(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, path = file_system(_set_file(base, part, attempt))
        at, out = 0, None
        for batch in batches:
            for _, _, words, codes, starts in coded(batch.column(1), "ascii"):
                flat, ends, key = _shingles(words, codes, starts, size)
                sets = [np.unique(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                n = np.array([len(s) for s in sets], np.int32)
                out = out or fs.open_output_stream(path, compression=None)
                out.write(np.concatenate(sets).tobytes())
                begin = at + np.cumsum(n, dtype=np.int64) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), attempt)), pa.array(begin), pa.array(n)], ["key", "part", "attempt", "start", "n"])
        if out:
            out.close()

    return cut(docs.mapInArrow(thrifty(of), "key long, part int, attempt long, start long, n int"), "near-sets")


def _set_file(base: str, part: int, attempt: int) -> str:
    return f"{base}/sets-{part:06d}-{attempt}"


def read_set(files: dict, base: str, part: int, attempt: int, start: int, n: int) -> np.ndarray:
    """One set from its file; ``files`` keeps those that are open."""
    if (part, attempt) not in files:
        fs, path = file_system(_set_file(base, part, attempt))
        files[part, attempt] = fs.open_input_file(path)
    return np.frombuffer(files[part, attempt].read_at(8 * n, 8 * start), U)


def group_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect all members of a group whose Jaccard similarity is ``similarity`` or more: each member in turn
    meets, all at once, those after it that are not yet connected with it."""
    count = len(sets)
    n = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(n)))
    root, links = np.arange(count), []
    for i in range(count - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        rest = rest[np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1e-9]
        if not len(rest):
            continue
        starts = np.concatenate(([0], np.cumsum(n[rest])))
        own = flat[np.repeat(at[rest] - starts[:-1], n[rest]) + np.arange(starts[-1])]
        k = np.minimum(np.searchsorted(sets[i], own), n[i] - 1)
        both = np.add.reduceat(sets[i][k] == own, starts[:-1], dtype=np.int64)
        for j in rest[both >= similarity * (n[i] + n[rest] - both) - 1e-9].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                links.append((i, j))
    return links


def _links(members: DataFrame, base: str, similarity: float) -> DataFrame:
    """(ka, kb) from members (band, key, part, attempt, start, n): each group is decided where its rows meet, a partition's groups one by one."""
    import pandas as pd

    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def of(batches):
        files: dict = {}
        held: list = []

        def solve(rows):
            rows = list({r[1]: r for r in rows}.values())  # a text's bands may agree
            links = group_links([read_set(files, base, *r[2:]) for r in rows], similarity) if len(rows) > 1 else []
            if links:
                yield pd.DataFrame({"ka": [rows[i][1] for i, _ in links], "kb": [rows[j][1] for _, j in links]})

        for pdf in batches:
            for row in pdf[["band", "key", "part", "attempt", "start", "n"]].itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)
        for file in files.values():
            file.close()

    return members.repartition(parts, "band").sortWithinPartitions("band", "key").mapInPandas(thrifty(of), "ka long, kb long")


def _meeting(members: DataFrame) -> DataFrame:
    """members (band, key) of bands with more than one, and how many."""
    several = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select(opaque("band").alias("b"), "size")
    return cut(members.join(several.hint("merge"), F.col("band") == F.col("b")).drop("b"), "near-members")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 3, crowd: int = 4096) -> DataFrame:
    """Edges (u, v) between ids: every two texts whose shingle sets have a Jaccard similarity of ``similarity`` or more are connected.

    Texts of equal words (A-Z lower-cased) are one class, under the least id. Classes meet in groups by bands of
    min-hashes: two of similarity 0.8 miss each other in all 24 bands of 3 with a probability of 4e-8. Groups of over
    ``crowd`` classes are dealt anew by pairs of bands (two of similarity 0.8 share fewer than two with a probability of
    8e-7). Whole sets of the classes that meet lie in files of the shared folder; a group's task reads its sets and decides
    exactly, skipping pairs that are connected already, and returns at most a link a member: pairs are never written out.

    Null ids, null and empty texts: no edges. Repeated rows: one class. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = cut(band_marks(docs, size, bands, rows), "near-marks")
    reps = cut(marks.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-classes")
    least = reps.select(opaque("key").alias("k"), "rep")
    equal = marks.select("key", "doc_id").join(least.hint("merge"), F.col("key") == F.col("k")).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    members = _meeting(reps.select("key", F.explode("bands").alias("band")))
    used = [marks, reps, members]
    small = members.where(F.col("size") <= crowd).select("band", "key")
    if not members.where(F.col("size") > crowd).isEmpty():
        again = members.where(F.col("size") > crowd).select("band", F.col("key").alias("k")).join(reps.select("key", "bands"), F.col("key") == F.col("k"))
        again = again.select("key", "band", F.explode("bands").alias("other")).where("other <> band").select("key", F.xxhash64(F.least("band", "other"), F.greatest("band", "other")).alias("band"))
        used.append(_meeting(again.distinct()))
        small = small.unionByName(used[-1].select("band", "key"))
    needed = reps.join(small.select(F.col("key").alias("k")).distinct(), F.col("key") == F.col("k"), "left_semi")
    needed = cut(needed.select(F.col("rep").alias("need")).distinct(), "near-needed")
    base = new_path(spark, "near-sets-files")
    make_dirs(spark, base)
    sets = write_sets(docs.join(near_or_exchanged(needed), F.col("doc_id") == F.col("need"), "left_semi"), size, base)
    place = sets.groupBy("key").agg(F.min(F.struct("part", "attempt", "start", "n")).alias("p")).select(opaque("key").alias("k"), "p.*")
    located = small.join(place.hint("merge"), F.col("key") == F.col("k")).select("band", "key", "part", "attempt", "start", "n")
    links = cut(_links(located, base, similarity).distinct(), "near-links")
    id_of = lambda x, name: reps.select(F.col("key").alias(f"k{x}"), F.col("rep").alias(name))
    edges = cut(links.join(id_of("a", "u"), "ka").join(id_of("b", "v"), "kb").select("u", "v").unionByName(equal), "near-edges")
    for done in (*used, needed, sets, links):
        drop(done)
    remove(spark, base)
    return edges
