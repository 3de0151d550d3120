"""SimHash near-dedup: 64-bit fingerprints linked within a Hamming radius by sharded BK-trees."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, opaque, table, thrifty
from .components import components


def fingerprint(data: bytes, size: int = 4, seed: int = 42) -> int:
    """SimHash of a text given as UTF-8, as a signed 64-bit integer; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[k : k + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(raw), 65536))
    bits = np.packbits(ones * 2 > len(raw), bitorder="little")
    return int(bits.view(np.int64)[0])


class BKForest:
    """BK-trees of many shards at once: a node's children are keyed by their integer Hamming distance to it."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """``values``: uint64, distinct within a shard. ``shard``: the shard of each, as small integers."""
        n = len(values)
        self.values, self.child = values, {}
        first = np.unique(shard, return_index=True)
        self.roots = dict(zip(first[0].tolist(), first[1].tolist(), strict=True))
        at = first[1][np.searchsorted(first[0], shard)]
        todo = np.flatnonzero(at != np.arange(n))
        keys, kids = [], []
        while len(todo):  # one level a round: of the points that want the same edge, the first becomes the child, the rest go below it
            code = at[todo] * 65 + np.bitwise_count(values[todo] ^ values[at[todo]])
            edge, index, back = np.unique(code, return_index=True, return_inverse=True)
            chosen = todo[index]
            keys.append(edge)
            kids.append(chosen)
            at[todo] = chosen[back]
            todo = todo[at[todo] != todo]
        keys, kids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(keys, kind="stable")
        self.keys, self.kids = keys[order], kids[order]

    def within(self, queries: np.ndarray, shard: np.ndarray, radius: int, visits: int = 1 << 19):
        """Yield (query index, node index) arrays of all pairs within ``radius``, following edges d - radius to d + radius only.

        So many queries walk at once that together they cannot stand on more than about ``visits`` nodes: in a shard of
        near copies every query visits every node.
        """
        largest = int(np.unique(shard, return_counts=True)[1].max(initial=1))
        step = max(1, min(4096, visits // largest))
        for lo in range(0, len(queries), step):
            q = np.arange(lo, min(lo + step, len(queries)))
            node = np.array([self.roots[s] for s in shard[q].tolist()], np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                a = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                b = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
                n = b - a
                q = np.repeat(q, n)
                node = self.kids[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]


def forest_edges(n: int, pairs) -> np.ndarray:
    """The least reachable index of each of ``n`` points, over batches of linked index pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root, jumped := root[root]):
                root = jumped
    return root


def _blocks(bits: int, parts: int) -> list[int]:
    return [bits // parts + (k < bits % parts) for k in range(parts)]


def _parts(keyed: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once for each of radius + 1 blocks of the bits still free: two within the radius agree on one block.

    ``free``: the bits of the fingerprint not yet used, low first, ``bits`` of them; ``shard``: hash of the blocks used so far.
    """
    bits = keyed.bits
    widths, low, made = _blocks(bits, radius + 1), 0, []
    for k, width in enumerate(widths):
        free = F.col("free")
        value = F.shiftrightunsigned(free, low).bitwiseAND(F.lit((1 << width) - 1))
        under = free.bitwiseAND(F.lit((1 << low) - 1))
        over = F.shiftrightunsigned(free, low + width) if low + width < 64 else F.lit(0).cast("long")
        rest = under.bitwiseOR(F.shiftleft(over, low)) if low < 64 else under
        made.append((F.xxhash64("shard", F.lit(k), value).alias("shard"), rest.alias("free"), bits - width))
        low += width
    if len({m[2] for m in made}) > 1:  # blocks differ by one bit: keep the larger number of free bits, the surplus bit is 0
        made = [(s, f, max(m[2] for m in made)) for (s, f, _), m in zip(made, made, strict=True)]
    out = keyed.select("fp", F.explode(F.array(*[F.struct(s, f) for s, f, _ in made])).alias("x")).select("fp", "x.shard", "x.free")
    out.bits = made[0][2]
    return out


def link(fps: DataFrame, radius: int = 4, shard_limit: int = 4096, levels: int = 3, bucket_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect the distinct 64-bit ``fp`` values within ``radius`` bits: a spanning forest of each shard.

    Fingerprints are dealt to shards by pigeonhole blocks (two within radius r agree on one of r + 1 blocks), each
    shard's BK-tree is built where its rows meet, and its members walk it. A shard of over ``shard_limit`` values is dealt
    anew by blocks of its remaining bits, so that shards stay small however many fingerprints there are; after ``levels``
    levels a shard that is still larger holds values that differ in few bits, and its tree is searched whole. Trees are
    sent to the tasks by the exchange on the shard, not from the driver: all fingerprints together have no size bound.
    """
    level = fps.select("fp", F.lit(0).cast("long").alias("shard"), F.col("fp").alias("free"))
    level.bits = 64
    edges = []
    for depth in range(levels):
        parts = _parts(level, radius)
        bits = parts.bits
        if depth + 1 < levels and bits > radius:
            sizes = parts.groupBy("shard").count().where(F.col("count") > shard_limit).select(F.col("shard").alias("hot"))
            sizes = cut(sizes, "hot-shards")
            hot = sizes.count()
        else:
            hot = 0
        calm = parts
        if hot:
            near = F.broadcast(sizes) if hot <= 100_000 else sizes
            calm = parts.join(near, F.col("shard") == F.col("hot"), "left_anti")
        edges.append(_tree_edges(calm.select("fp", "shard"), radius, bucket_rows))
        if not hot:
            break
        level = parts.join(near, F.col("shard") == F.col("hot"), "left_semi")
        level.bits = bits
    return reduce(DataFrame.unionByName, edges)


def _tree_edges(members: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    import pandas as pd

    n = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def of_partition(batches):
        held, rows, last = [], 0, None

        def solve(pdf):
            values, (_, shard) = pdf["fp"].to_numpy().view(np.uint64), np.unique(pdf["shard"].to_numpy(), return_inverse=True)
            root = forest_edges(len(values), BKForest(values, shard).within(values, shard, radius))
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pd.DataFrame({"a": pdf["fp"].to_numpy()[moved], "b": pdf["fp"].to_numpy()[root[moved]]})

        for pdf in batches:  # sorted by shard: what is complete goes once there is enough of it
            held.append(pdf)
            rows += len(pdf)
            if rows >= bucket_rows and (last := pdf["shard"].iloc[-1]) != held[0]["shard"].iloc[0]:
                whole = pd.concat(held, ignore_index=True)
                done = whole["shard"] != last
                yield solve(whole[done].reset_index(drop=True))
                held = [whole[~done]]
                rows = len(held[0])
        if rows:
            yield solve(pd.concat(held, ignore_index=True))

    return members.repartition(n, "shard").sortWithinPartitions("shard").mapInPandas(of_partition, "a long, b long")


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of whole texts; null and empty texts have fingerprint 0."""
    import pandas as pd

    def of(batches):
        for pdf in batches:
            fp = [fingerprint(t.encode("utf-8", "surrogatepass"), size, seed) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array(fp, np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(thrifty(of), "doc_id long, fp long")


def simhash_components(docs: DataFrame, size: int = 4, seed: int = 42, radius: int = 4, shard_limit: int = 4096) -> DataFrame:
    """doc_id, fp (signed), fingerprint (16 hex digits), component_id (least doc_id reachable by links) per row of ``docs``.

    ``docs`` has doc_id and text. Equal fingerprints are collapsed first, so a group of copies of any size is one member.
    Null and empty texts: fingerprint 0, linked like any other. Null ids: component_id is null and they link with
    nothing. Repeated rows are returned as often, in one component. Very long texts are read whole. An empty table gives
    no rows. Other columns are ignored.
    """
    rows = cut(fingerprints(docs, size, seed), "fingerprints")
    reps = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    edges = cut(link(reps, radius, shard_limit), "fingerprint-edges")
    # ids only where there is an edge
    rep = reps.select(F.col("fp").alias("f"), "rep")
    ids = edges.join(rep, F.col("a") == F.col("f")).select("b", F.col("rep").alias("u")).join(rep, F.col("b") == F.col("f")).select("u", F.col("rep").alias("v"))
    found = components(ids)
    full = cut(reps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id")), "fingerprint-components")
    drop(edges)
    out = rows.join(full.hint("merge"), F.col("fp") == F.col("f"), "left")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
