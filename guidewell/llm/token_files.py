"""Token files: a wavelet matrix per shard, its bit-planes in compressed blocks with rank directories, in one file."""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, file_system, make_dirs, new_path, table
from .tokens import SLICE_BYTES, encoder, with_end

MAGIC = b"GWWM0001"
#: Bits in a block of a plane: what one lookup reads and inflates.
BLOCK = 1 << 17
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, bytes long"


def planes_of(values: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit-planes, most significant first, each in the order in which the planes above it sorted the values; and the zeros of each."""
    planes, zeros, now = [], [], values
    for b in range(bits - 1, -1, -1):
        bit = (now >> np.asarray(b, now.dtype) & np.asarray(1, now.dtype)).astype(bool)
        planes.append(np.packbits(bit, bitorder="little"))
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate([low, now[bit]])
    return planes, zeros


def values_of(planes: list[np.ndarray], n: int, dtype=np.uint16) -> np.ndarray:
    """All values, from the last plane up: each plane tells which came from its zeros and which from its ones."""
    now = np.zeros(n, dtype)
    for b, plane in enumerate(reversed(planes)):
        bit = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        up = np.empty(n, dtype)
        z = n - int(np.count_nonzero(bit))
        up[~bit] = now[:z]
        up[bit] = now[z:] | np.asarray(1 << b, dtype)
        now = up
    return now


def write_shard(uri: str, doc_ids: list, counts: np.ndarray, values: np.ndarray, level: int = 1) -> int:
    """Write one shard; returns its bytes. Layout: magic, compressed blocks, compressed directory, its length, magic."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    bits = max(1, int(values.max()).bit_length()) if len(values) else 1
    planes, zeros = planes_of(values, bits)
    fs, path = file_system(uri)
    with fs.open_output_stream(path, compression=None) as out:
        at = out.write(MAGIC)
        where = []
        for plane in planes:
            blocks, ones = [], 0
            for k in range(0, len(plane), BLOCK // 8):
                part = plane[k : k + BLOCK // 8]
                data = pack(part.tobytes())
                blocks.append((at, len(data), ones))
                ones += int(np.bitwise_count(part).sum())
                at += out.write(data)
            where.append(blocks)
        head = {"n": len(values), "bits": bits, "zeros": zeros, "blocks": where, "doc_ids": doc_ids, "counts": counts.tolist()}
        tail = pack(json.dumps(head).encode())
        at += out.write(tail) + out.write(struct.pack("<Q", len(tail)) + MAGIC)
    return at


class Shard:
    """Random access into one file: ``access``, ``rank``, ``count``, ``select`` and whole ``documents``; reads only the blocks it needs."""

    def __init__(self, uri: str):
        import zstandard

        self._unpack = zstandard.ZstdDecompressor().decompress
        fs, path = file_system(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        n, magic = struct.unpack("<Q8s", self._file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        head = json.loads(self._unpack(self._file.read_at(n, size - 16 - n)))
        self.n, self.bits, self.zeros, self._blocks = head["n"], head["bits"], head["zeros"], head["blocks"]
        self.doc_ids, self.counts = head["doc_ids"], np.array(head["counts"], np.int64)
        self._block = lru_cache(maxsize=64)(self._load)

    def close(self) -> None:
        self._file.close()

    def _load(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, n, _ = self._blocks[plane][k]
        words = np.frombuffer(self._unpack(self._file.read_at(n, at)).ljust(BLOCK // 8, b"\0"), np.uint64)
        return words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, j = divmod(i, BLOCK)
        if k == len(self._blocks[plane]):  # at the very end
            return self.n - self.zeros[plane]
        words, before = self._block(plane, k)
        w, r = divmod(j, 64)
        return self._blocks[plane][k][2] + int(before[w]) + (int(words[w]) & ((1 << r) - 1)).bit_count() if r else self._blocks[plane][k][2] + int(before[w])

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            ones = self._ones(p, i)
            bit = self._ones(p, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Start of the token's run below the last plane, and where position i falls in that order."""
        lo = 0
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, i)
            lo, i = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, i - b)
        return lo, i

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before position i."""
        lo, at = self._range(token, i)
        return at - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(token, self.n if hi is None else hi) - self.rank(token, lo)

    def _nth(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        blocks = self._blocks[plane]
        before = lambda j: blocks[j][2] if bit else j * BLOCK - blocks[j][2]
        lo, hi = 0, len(blocks)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        words, ones = self._block(plane, lo)
        k -= before(lo)
        counts = ones if bit else np.arange(len(ones)) * 64 - ones
        w = int(np.searchsorted(counts, k, side="right")) - 1
        k -= int(counts[w])
        word = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little")
        return lo * BLOCK + w * 64 + int(np.flatnonzero(word == bit)[k])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._nth(p, bit, i - self.zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        planes = []
        for blocks in self._blocks:
            planes.append(np.frombuffer(b"".join(self._unpack(self._file.read_at(n, at)) for at, n, _ in blocks), np.uint8))
        return values_of(planes, self.n)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, spaces: bool = False, shard_tokens: int = 4_000_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write wavelet-matrix shards in ascending doc_id order; returns the manifest.

    Rows are dealt by ranges of doc_id, so files in order of (part, seq) hold ascending documents; each task writes files
    of about ``shard_tokens`` under names of its own attempt, and only files in the manifest count, so a task that is run
    again does no harm. Memory is one shard. Null ids come first. Null and empty texts have the end id alone; repeated
    rows are written as often; an empty table gives an empty manifest; other columns are ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    base = new_path(spark, "tokens")
    make_dirs(spark, base)

    def of_partition(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, seq, held, tokens = task.partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, tokens
            path = f"{base}/{part:06d}-{seq:05d}-{task.taskAttemptId()}.gwwm"
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            size = write_shard(path, [d for h in held for d in h[0].to_pylist()], counts, ids)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]), pa.array([len(counts)]), pa.array([len(ids)]), pa.array([size])], ["part", "seq", "path", "n_docs", "n_tokens", "bytes"])
            seq, held, tokens = seq + 1, [], 0
            return row

        waiting: list = []

        def encode():
            nonlocal tokens, waiting
            keys, texts = (pa.concat_arrays([b.column(k) for b in waiting]) for k in (0, 1))
            waiting = []
            flat, counts = with_end(*encoder(tokenizer, spaces, slice_bytes=2 * SLICE_BYTES).encode(texts), end_id)
            held.append((keys, flat, counts))
            tokens += len(flat)

        for batch in batches:  # texts that are encoded together share one look at each of their words
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) >= SLICE_BYTES:
                encode()
            if tokens >= shard_tokens:
                yield flush()
        if waiting:
            encode()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(of_partition, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of each document, from the files."""
    import pyarrow as pa

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def of_partition(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                data, counts, ids = shard.tokens().astype("<u4").tobytes(), shard.counts, shard.doc_ids
                shard.close()
                starts = np.cumsum(counts) - counts
                for k in range(0, len(ids), 4096):
                    s, c = starts[k : k + 4096], counts[k : k + 4096]
                    blobs = [data[4 * a : 4 * (a + n)] for a, n in zip(s.tolist(), c.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 4096], pa.int64()), pa.array(s + base), pa.array(c), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    files = cut(files, "token-files")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(of_partition, "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    read = read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
