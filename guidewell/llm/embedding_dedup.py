"""Embedding near-dedup: PCA-ordered tiles, leading dimensions first, residual products bounded by suffix norms."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, file_system, make_dirs, new_path, table
from .components import components
from .simhash import forest_edges

LINKS = "v long, m long, root long"


class Turned:
    """Vectors with their norms, their unit vectors in PCA order and the norms of each suffix of these."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray):
        self.x, self.norm = x, np.sqrt(np.einsum("ij,ij->i", x, x))
        self.unit = (x / self.norm[:, None]) @ rotation
        squares = np.cumsum((self.unit * self.unit)[:, ::-1], axis=1)[:, ::-1]
        self.tail = np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


def linked_pairs(a: Turned, b: Turned, threshold: float, step: int = 16, same: bool = False, slack: float = 1e-9):
    """(i, j) with cosine(a[i], b[j]) >= threshold in double precision; with ``same``, i < j only.

    Products gather ``step`` dimensions at a time; what is left of a pair can add at most the product of its two suffix
    norms, so a pair leaves as soon as that cannot reach the threshold. The pairs that stay to the end are decided by the
    cosine of the vectors as given.
    """
    d = a.x.shape[1]
    k = min(step, d)
    gathered = a.unit[:, :k] @ b.unit[:, :k].T
    alive = gathered + np.outer(a.tail[:, k], b.tail[:, k]) >= threshold - slack
    if same:
        alive &= np.tri(len(a.x), len(b.x), -1, bool).T
    i, j = np.nonzero(alive)
    got = gathered[i, j]
    while k < d and len(i):
        nxt = min(k + step, d)
        got = got + np.einsum("ij,ij->i", a.unit[i, k:nxt], b.unit[j, k:nxt])
        k = nxt
        stay = got + a.tail[i, k] * b.tail[j, k] >= threshold - slack
        i, j, got = i[stay], j[stay], got[stay]
    sure = np.einsum("ij,ij->i", a.x[i], b.x[j]) / (a.norm[i] * b.norm[j]) >= threshold
    return i[sure], j[sure]


def padded(vectors, d: int) -> np.ndarray:
    """Vectors as scaled rows of ``d`` components; what a shorter one lacks is 0, which changes no product with one of its own length."""
    out = np.zeros((len(vectors), d))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return scaled(out)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two each, so that the largest component is about 1: cosines stay as they are to the last bit, and no square underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Principal directions of the unit vectors, largest share first: d x d sums gathered per partition, then added in a tree."""

    def sums(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            x = padded(pdf["vec"], d)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            total += x.T @ x
        yield __import__("pandas").DataFrame({"k": np.arange(d * d), "s": total.ravel()})

    cells = vectors.select("vec").mapInPandas(sums, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # d x d numbers
    total = np.zeros(d * d)
    for k, s in cells:
        total[k] = s
    w, v = np.linalg.eigh(total.reshape(d, d))
    return np.ascontiguousarray(v[:, np.argsort(-w)])


def _write_tiles(placed: DataFrame, base: str, tile_rows: int, n: int) -> DataFrame:
    """Rows of a cell, in tiles of at most ``tile_rows``, as files in the shared folder (one a task): label, cell, tile, path, start,
    bytes, rows. Tables of the tiles, not of their rows, decide what meets; files of attempts that failed are never named."""
    import pandas as pd

    label = placed.schema["label"].dataType.simpleString()

    def of(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = file_system(f"{base}/tiles-{context.partitionId():06d}-{context.taskAttemptId()}")
        out, at, made, held = None, 0, [], []

        def flush():
            nonlocal out, at, held
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            out = out or fs.open_output_stream(path, compression=None)
            for tile, a in enumerate(range(0, len(whole), tile_rows)):
                part = whole.iloc[a : a + tile_rows]
                data = np.concatenate([part["v"].to_numpy(np.int64).view(np.uint8), part["m"].to_numpy(np.int64).view(np.uint8), np.frombuffer(b"".join(part["vec"]), np.uint8)]).tobytes()
                out.write(data)
                made.append((whole["label"].iloc[0], list(whole["cell"].iloc[0]), whole["part"].iloc[0] << 32 | tile, at, len(data), len(part)))
                at += len(data)
            held = []

        key = None
        for pdf in batches:  # sorted by label, cell and part of the cell
            names = list(zip(pdf["label"], map(tuple, pdf["cell"]), pdf["part"], strict=True))
            edges = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and names[a] != key:
                    flush()
                key = names[a]
                held.append(pdf.iloc[a:b])
        if held:
            flush()
        if out:
            out.close()
            uri = f"{base}/tiles-{context.partitionId():06d}-{context.taskAttemptId()}"
            yield pd.DataFrame([(y, c, t, uri, s, size, k) for y, c, t, s, size, k in made], columns=["label", "cell", "tile", "path", "start", "bytes", "n"])

    dealt = placed.repartition(n, "label", "cell", "part").sortWithinPartitions("label", "cell", "part")
    return cut(dealt.mapInPandas(of, f"label {label}, cell array<long>, tile long, path string, start long, bytes long, n int"), "tiles")


@lru_cache(maxsize=8)
def _tile(path: str, start: int, size: int, n: int, d: int, turn: bytes) -> tuple:
    """ids, copies, vectors, norms, rotated unit vectors and their suffix norms of a tile, read from its file."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as file:
        data = np.frombuffer(file.read_at(size, start), np.uint8)
    v, m = data[: 8 * n].view(np.int64), data[8 * n : 16 * n].view(np.int64)
    x = data[16 * n :].view(np.float64).reshape(n, d)
    return v, m, Turned(x, np.frombuffer(turn, np.float64).reshape(d, d))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, grid_dims: int = 3, tile_rows: int = 512, step: int = 16) -> DataFrame:
    """One row per row of ``rows``: id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine is at least ``threshold``. Equal vectors of a
    label are collapsed first. The rest are turned into PCA order and dealt to cells of the leading ``grid_dims``
    coordinates, as wide as the link distance: links join only neighbour cells. A cell's rows form tiles of at most
    ``tile_rows``, each written once, into files of the shared folder. Pairs of tiles, of one cell or of neighbours, are
    pieces of work that name tiles and read them (two in memory); each returns, per vector, how many it links with and the
    least it is connected to. So vectors are exchanged once, and pairs of vectors are never written out.

    Vectors that are null, empty, zero, or hold null or non-finite components, null labels and null ids: no links,
    component_id is the id itself. Vectors of different lengths do not link. Repeated ids: one component (links are counted
    by row). An empty table gives no rows; other columns are ignored.
    """
    import pandas as pd

    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    own = F.col("id").alias("component_id")
    names = lambda t: t.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    vectors = cut(good.groupBy("label", "vec").agg(F.min("id").alias("v"), F.count("*").alias("m")), "vectors")
    d = vectors.agg(F.max(F.size("vec"))).first()[0]
    if d is None:
        return names(given.select("id", F.lit(0).cast("long").alias("n_links"), own))
    turn = _rotation(vectors, d)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    g = min(grid_dims, d)

    def cells(batches):
        for pdf in batches:
            x = padded(pdf["vec"], d)
            lead = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ turn[:, :g]
            home = np.concatenate([[[len(v)] for v in pdf["vec"]], np.floor(lead / width).astype(np.int64)], axis=1)  # vectors of one length meet
            yield pd.DataFrame({"label": pdf["label"], "cell": list(home), "v": pdf["v"], "m": pdf["m"], "vec": [r.tobytes() for r in x]})

    label = vectors.schema["label"].dataType.simpleString()
    placed = cut(vectors.mapInPandas(cells, f"label {label}, cell array<long>, v long, m long, vec binary"), "cells")
    # a cell of very many rows is written by several tasks
    counts = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / (16 * tile_rows)).alias("parts")).where("parts > 1")
    crowded = cut(counts.select(F.col("label").alias("l"), F.col("cell").alias("c"), "parts"), "crowded-cells")
    placed = placed.join(crowded, (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c")), "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("long"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = new_path(spark, "pca-tiles")
    make_dirs(spark, base)
    tiles = _write_tiles(placed.select("label", "cell", "part", "v", "m", "vec"), base, tile_rows, n)
    # each tile, with a number in order of its place, looks for partners in its own cell (once each pair) and in those neighbours whose first other coordinate is larger
    place = F.struct("path", "start", "bytes", "n")
    moves = [move for move in np.ndindex(*[3] * g) if next((x for x in move if x != 1), 2) == 2]
    around = F.array(*[F.struct(F.array(F.get("cell", F.lit(0)), *[F.get("cell", F.lit(k + 1)) + F.lit(x - 1) for k, x in enumerate(move)]).alias("near"), F.lit(all(x == 1 for x in move)).alias("home")) for move in moves])
    left = tiles.select("label", F.col("tile").alias("i"), place.alias("a"), F.explode(around).alias("to")).select("label", "i", "a", F.col("to.near").alias("cell"), "to.home")
    right = tiles.select("label", "cell", F.col("tile").alias("j"), place.alias("b"))
    work = left.join(right, ["label", "cell"]).where("not home or i <= j").select("a", "b", (F.col("a.path") == F.col("b.path")).alias("same"))
    work = work.withColumn("same", F.col("same") & (F.col("a.start") == F.col("b.start")))
    # pairs are dealt evenly, those of one tile mostly together
    work = cut(work, "tile-pairs").repartition(n, "a.path", "a.start", F.pmod(F.xxhash64("b.path", "b.start"), F.lit(8))).sortWithinPartitions("a.path", "a.start")
    sent = turn.tobytes()

    def compare(batches):
        for pdf in batches:
            for a, b, same in zip(pdf["a"], pdf["b"], pdf["same"], strict=True):
                va, ma, xa = _tile(a["path"], a["start"], a["bytes"], a["n"], d, sent)
                vb, mb, xb = (va, ma, xa) if same else _tile(b["path"], b["start"], b["bytes"], b["n"], d, sent)
                i, j = linked_pairs(xa, xb, threshold, step, same)
                if not len(i):
                    continue
                v, k = (va, j) if same else (np.concatenate([va, vb]), j + len(va))
                links = np.zeros(len(v), np.int64)
                np.add.at(links, i, mb[j])
                np.add.at(links, k, ma[i])
                order = np.argsort(v, kind="stable")  # least index = least id
                rank = np.empty(len(v), np.int64)
                rank[order] = np.arange(len(v))
                root = order[forest_edges(len(v), [(rank[i], rank[k])])[rank]]
                hit = np.flatnonzero(links)
                yield pd.DataFrame({"v": v[hit], "m": links[hit], "root": v[root[hit]]})
        _tile.cache_clear()

    out = cut(work.mapInPandas(compare, LINKS), "links")
    found = components(out.select("v", "root"), "v", "root")
    links = out.groupBy("v").agg(F.sum("m").alias("links"))
    known = vectors.select("label", "vec", "v", "m").join(links, "v", "left").join(found, F.col("v") == F.col("node"), "left")
    known = cut(known.select(F.col("label").alias("kl"), F.xxhash64("label", "vec").alias("kh"), F.col("vec").alias("kv"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "v").alias("component_id")), "known")
    keyed = given.withColumn("h", F.xxhash64("label", "vec"))
    joined = keyed.join(known.hint("merge"), (F.col("h") == F.col("kh")) & (F.col("label") == F.col("kl")) & (F.col("vec") == F.col("kv")) & F.col("id").isNotNull(), "left")
    for used in (vectors, crowded, tiles, out):
        drop(used)
    return names(joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))


def op1_pca_tiles(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
