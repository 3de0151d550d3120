"""Packing documents into fixed windows: non-negative least squares over length combinations, then a greedy rest."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, thrifty
from .tokens import REMEMBERED, SLICE_BYTES, encoder, with_end

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def combinations(histogram: np.ndarray, window: int, triples: int = 4) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill the window: all pairs, and for each length some triples with the most frequent others."""
    there = np.flatnonzero(histogram)
    has = histogram > 0
    a = there[(there * 2 <= window) & (there < window)]
    a = a[has[window - a]]
    rows = [np.stack([window - a, a, np.zeros_like(a)], axis=1)]
    common = there[np.argsort(-histogram[there], kind="stable")]
    for n in there.tolist():
        rest = window - n
        b = common[common < rest]
        b = b[has[rest - b]][: 2 * triples]
        if len(b):
            rows.append(np.stack([np.full_like(b, n), b, rest - b], axis=1))
    made = -np.sort(-np.concatenate(rows), axis=1)
    return np.unique(made, axis=0) if len(made) else made


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 120) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, where a column of A holds how often a combination uses each length.

    Multiplicative updates: x <- x * (A'h) / (A'A x), which never leave x >= 0 nor raise the error.
    """
    size, used = len(histogram), combos > 0
    target = np.where(used, histogram[combos], 0).sum(axis=1).astype(float)
    x = target / np.maximum(used.sum(axis=1), 1) / 4 + 1e-9
    for _ in range(rounds):
        fit = np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]), minlength=size)
        fit[0] = 0
        x *= target / np.maximum(np.where(used, fit[combos], 0).sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """(lengths, how often) of the solved and rounded combinations; together never more than the histogram has."""
    left, out = histogram.copy(), []
    combos = combinations(histogram, window)
    if not len(combos):
        return out
    x = repeat_counts(combos, histogram)
    for k in np.argsort(-x, kind="stable").tolist():
        if (n := int(x[k] + 0.5)) < 1:
            break
        lengths = [c for c in combos[k].tolist() if c]
        n = min(n, *(int(left[c]) // lengths.count(c) for c in lengths))
        if n:
            for c in lengths:
                left[c] -= n
            out.append((lengths, n))
    return out


def pack(totals: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset) of documents of ``totals`` tokens, and the number of sequences.

    Whole windows of a document are sequences of their own. The remainders' histogram is met by combinations that fill a
    window; those left over are packed greedily, largest first, then the largest that fits, and where none fits a piece
    is cut. So every sequence is full, but for the last few of a block, whose lengths are powers of two: no padding.
    """
    docs, whole, rest = np.arange(len(totals)), totals // window, totals % window
    owner = np.repeat(docs, whole)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces = [np.stack([owner, nth * window, np.full(len(owner), window), np.arange(len(owner)), np.zeros(len(owner), np.int64)], axis=1)]
    n_seq = len(owner)
    pool: dict[int, list[tuple[int, int]]] = {}
    for d in np.flatnonzero(rest).tolist():
        pool.setdefault(int(rest[d]), []).append((d, int(whole[d]) * window))
    made: list[tuple[int, int, int, int, int]] = []
    for lengths, n in plan(np.bincount(rest[rest > 0], minlength=window + 1), window):
        for _ in range(n):
            at = 0
            for c in lengths:
                made.append((*pool[c].pop(), c, n_seq, at))
                at += c
            n_seq += 1
    open_ = sorted(c for c, own in pool.items() if own)
    left = sum(c * len(pool[c]) for c in open_)

    def take(c: int) -> tuple[int, int]:
        own = pool[c]
        piece = own.pop()
        if not own:
            del open_[bisect_left(open_, c)]
        return piece

    def put(c: int, piece: tuple[int, int]) -> None:
        if not pool.setdefault(c, []):
            insort(open_, c)
        pool[c].append(piece)

    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        at = 0
        while at < size:
            k = bisect_right(open_, size - at) - 1
            if k >= 0:
                c = open_[k]
                made.append((*take(c), c, n_seq, at))
            else:
                c, space = open_[0], size - at
                d, start = take(c)
                made.append((d, start, space, n_seq, at))
                put(c - space, (d, start + space))
                c = space
            at += c
        left -= size
        n_seq += 1
    pieces.append(np.array(made, np.int64).reshape(-1, 5))
    return np.concatenate(pieces), n_seq


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, block_tokens: int = 4_000_000, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens: SCHEMA, ``ids`` as little-endian unsigned 32-bit integers.

    ``docs`` has doc_id and text. A document is its ids and then ``end_id``. Each task packs its documents in blocks of
    about ``block_tokens``, each block with its own histogram and solution, so there is no exchange, no driver step, and
    memory is one block; a lost task is simply run again. Sequence ids are unique (task, then number in the task), and
    offsets in a sequence have no gaps. Sequences are full, or end at a power of two, which is not padded. ``remembered`` words
    and ``slice_bytes`` of text at a time set the worker's memory against speed; ids are the same.

    Null and empty texts: the end id alone. Null ids stay null. Repeated rows are documents of their own. Very long texts
    fill as many windows as they need. An empty table gives no rows. Other columns are ignored.
    """
    import pyarrow as pa

    def of_partition(batches):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal own, held, tokens
            ids = np.concatenate([h[1] for h in held])
            totals = np.concatenate([h[2] for h in held])
            key = pa.concat_arrays([h[0] for h in held])
            held, tokens = [], 0
            pieces, n_seq = pack(totals, window)
            starts = (np.cumsum(totals) - totals)[pieces[:, 0]] + pieces[:, 1]
            for k in range(0, len(pieces), 2048):  # ids as they are sent, a few pieces at a time
                own_pieces = pieces[k : k + 2048]
                blobs = [ids[s : s + n].astype("<u4").tobytes() for s, n in zip(starts[k : k + 2048].tolist(), own_pieces[:, 2].tolist(), strict=True)]
                columns = [key.take(pa.array(own_pieces[:, 0])), own_pieces[:, 1], own_pieces[:, 2], totals[own_pieces[:, 0]], own_pieces[:, 3] + own, own_pieces[:, 4], pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            own += n_seq

        waiting: list = []

        def encode():
            nonlocal tokens, waiting
            keys, texts = (pa.concat_arrays([b.column(k) for b in waiting]) for k in (0, 1))
            waiting = []
            flat, counts = with_end(*encoder(tokenizer, True, remembered, 2 * slice_bytes).encode(texts), end_id)
            held.append((keys, flat, counts))
            tokens += len(flat)

        for batch in batches:  # texts that are encoded together share one look at each of their words
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= slice_bytes:
                encode()
            if tokens >= block_tokens:
                yield from flush()
        if waiting:
            encode()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(thrifty(of_partition, "tokens"), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))
