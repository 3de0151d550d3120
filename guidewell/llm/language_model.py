"""LM scoring: an interpolated trigram model in Elias-Fano tries, written in parts and memory-mapped by the tasks that score."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHES, crc_fold, cut, file_system, make_dirs, new_path, table, thrifty
from .elias_fano import EliasFano, encode
from .features import coded

#: No word holds white space, so these are none.
END = "\n"
SCHEMA = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
SEED, U = 11, np.uint64
TOP = 256  # most frequent words that each part of the vocabulary reports
SLICE_BYTES = 6 << 20  # texts of a slice share one look at each of their words
FLUSH = 2_000_000  # trigrams that a task gathers before it sorts and sends them on


# ---- files --------------------------------------------------------------------------------------------------------


def write_arrays(uri: str, arrays: dict[str, np.ndarray], **more) -> None:
    """One file: a line of JSON, padded, then the arrays, each at a multiple of 8 bytes."""
    at, head = 0, {}
    for name, a in arrays.items():
        head[name] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    line = json.dumps({"arrays": head, **more}).encode()
    line += b" " * (-(len(line) + 9) % 8)
    fs, path = file_system(uri)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(b"%08d" % len(line) + line + b"\n")
        for a in arrays.values():
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def map_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays of a file, memory-mapped where the shared folder is mounted, else read; and what else its first line says."""
    from pyarrow import fs as afs

    fs, path = file_system(uri)
    if isinstance(fs, afs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with fs.open_input_file(path) as file:
            data = np.frombuffer(file.read(), np.uint8)
    n = int(bytes(data[:8]))
    head = json.loads(bytes(data[8 : 8 + n]))
    start = 8 + n + 1
    return {k: data[start + at : start + at + m * np.dtype(t).itemsize].view(t) for k, (at, m, t) in head["arrays"].items()}, head


def _ef(name: str, values: np.ndarray, sought: bool = True) -> tuple[dict, dict]:
    e = encode(values, sought)
    return {f"{name}_{k}": e[k] for k in ("low", "high", "before")}, {name: [e[k] for k in ("base", "n", "low_bits", "buckets")]}


def _levels(**levels: tuple[np.ndarray, bool]) -> tuple[dict, dict]:
    """Arrays and heads of several sequences, each with whether its values are sought or read by place."""
    arrays, heads = {}, {}
    for name, (values, sought) in levels.items():
        a, h = _ef(name, values, sought)
        arrays |= a
        heads |= h
    return arrays, heads


def _level(arrays: dict, head: dict, name: str) -> EliasFano:
    return EliasFano(*head[name], arrays[f"{name}_low"], arrays[f"{name}_high"], arrays[f"{name}_before"])


def quantised(log10p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte each, and the code book of at most 256 values: the values themselves, or bins, each by its mean; half of
    the limits fill bins evenly, half part the distinct values evenly, for most entries may share a few values."""
    if not len(log10p):
        return np.zeros(0, np.uint8), np.zeros(1)
    distinct = np.unique(log10p)
    if len(distinct) <= 256:
        return np.searchsorted(distinct, log10p).astype(np.uint8), distinct
    edges = np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, 128)[1:-1]) for x in (log10p, distinct)]))
    code = np.searchsorted(edges, log10p)
    n = np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), np.bincount(code, weights=log10p, minlength=len(edges) + 1) / np.maximum(n, 1)


# ---- words --------------------------------------------------------------------------------------------------------


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in words), U, len(words))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts by range of a 64-bit hash."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blob(*arrays: np.ndarray) -> bytes:
    """Ascending or small integers as differences, byte by byte, compressed."""
    import zstandard

    out = []
    for a in arrays:
        d = np.diff(a.astype(U), prepend=U(0))
        out.append(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())
    return len(arrays[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unblob(data: bytes, n_arrays: int) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(n_arrays, 8, n)
    return [np.cumsum(np.ascontiguousarray(r.T).view(U).ravel(), dtype=U) for r in raw]


class Vocabulary:
    """Words by rank of their hash, with exact training counts: differences of running sums, which are monotone too."""

    def __init__(self, paths: list[str], sizes: list[int]):
        self.offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.size, self.parts = int(self.offsets[-1]), len(paths)
        self.files = [map_arrays(p) for p in paths]
        self.levels, self.sums = ([_level(a, h, name) for a, h in self.files] for name in ("hash", "sum"))

    def counts(self, part: int, k: np.ndarray) -> np.ndarray:
        lo, hi = self.sums[part].bounds(k)
        return hi - lo

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)  # neighbours in the files are looked up together
        ends = np.searchsorted(_part(hashes[order], self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[p] : ends[p + 1]]
            k = self.levels[p].find(hashes[own])
            hit = k >= 0
            ids[own[hit]] = k[hit] + self.offsets[p]
            counts[own[hit]] = self.counts(p, k[hit])
        return ids, counts


class Layout:
    """Which part holds the followers of a context: by hash of the context, frequent first words dealt over slots of their next word."""

    def __init__(self, size: int, parts: int, hot: dict[int, int]):
        self.size, self.parts = size, parts
        self.width = size + 2  # with the start of a text and the pad after its end
        self.start, self.pad = size, size + 1
        self.hot = np.array(sorted(hot), np.int64)
        self.slots = np.array([hot[h] for h in sorted(hot)], np.int64)

    def part(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        slot = np.zeros(len(w1), U)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, w1), len(self.hot) - 1)
            own = np.flatnonzero(self.hot[at] == w1)
            slot[own] = _mix(w2[own].astype(U)) % self.slots[at[own]].astype(U)
        return _part(_mix(w1.astype(U) * U(0x9E3779B97F4A7C15) + slot), self.parts)


class Model:
    """The mapped tries of all parts, with what scoring needs of the whole."""

    def __init__(self, vocabulary: Vocabulary, layout: Layout, paths: list[str], hot_backoff: dict[int, float]):
        self.vocabulary, self.layout = vocabulary, layout
        self.files = [map_arrays(p) for p in paths]
        self.levels = [{name: _level(a, h, name) for name in ("one", "two", "three", "two_at", "three_at")} for a, h in self.files]
        self.books = [{n: 10.0 ** a[f"{n}_book"] for n in ("one", "two", "back", "three")} for a, _ in self.files]
        self.hot_words = np.array(sorted(hot_backoff), np.int64)
        self.hot_values = np.array([hot_backoff[w] for w in sorted(hot_backoff)])

    def _by_part(self, w1: np.ndarray, w2: np.ndarray):
        """Yield each part with the queries it answers, in order of their words, so neighbours in its file are looked up together."""
        order = np.argsort(w1.astype(U) * U(self.layout.width) + w2.astype(U))
        part = self.layout.part(w1, w2)[order]
        again = np.argsort(part.astype(np.uint16) if self.layout.parts <= 65536 else part, kind="stable")
        order, part = order[again], part[again]
        ends = np.searchsorted(part, np.arange(self.layout.parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            yield p, order[ends[p] : ends[p + 1]]

    def followers(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray):
        """The discounted P(w2 | w1) (0 where not kept), what (w1, w2) hands to shorter contexts (1 where not kept), and the discounted P(w3 | w1 w2).

        Down the trie: each first word once, by its place; its pointers bound where w2 is sought among its children, by the
        number of the context; the pointers of the pair bound where w3 is.
        """
        n, width = len(w1), U(self.layout.width)
        p2, back, p3 = np.zeros(n), np.ones(n), np.zeros(n)
        for p, own in self._by_part(w1, w2):
            arrays, books, levels = self.files[p][0], self.books[p], self.levels[p]
            first = np.flatnonzero(np.diff(w1[own], prepend=-1))
            context = levels["one"].find(w1[own[first]].astype(U))
            there = context >= 0
            times = np.diff(np.append(first, len(own)))
            own = own[np.repeat(there, times)]
            context, lo, hi = (np.repeat(x, times[there]) for x in (context[there], *levels["two_at"].bounds(context[there])))
            k = levels["two"].find(context.astype(U) * width + w2[own].astype(U), (lo, hi))
            own, k = own[k >= 0], k[k >= 0]
            p2[own] = books["two"][arrays["two_code"][k]]
            back[own] = books["back"][arrays["back_code"][k]]
            lo, hi = levels["three_at"].bounds(k)
            own, k, lo, hi = (x[lo < hi] for x in (own, k, lo, hi))
            j = levels["three"].find(k.astype(U) * width + w3[own].astype(U), (lo, hi))
            p3[own[j >= 0]] = books["three"][arrays["three_code"][j[j >= 0]]]
        return p2, back, p3

    def backoff(self, w1: np.ndarray) -> np.ndarray:
        """What each single-word context hands to the unigrams, 1 where it has no followers: beside its place, of frequent words in a small table."""
        out = np.ones(len(w1))
        for p, own in self._by_part(w1, np.full(len(w1), self.layout.pad)):
            k = self.levels[p]["one"].find(w1[own].astype(U))
            out[own[k >= 0]] = self.books[p]["one"][self.files[p][0]["one_code"][k[k >= 0]]]
        if len(self.hot_words):
            at = np.minimum(np.searchsorted(self.hot_words, w1), len(self.hot_words) - 1)
            own = self.hot_words[at] == w1
            out[own] = self.hot_values[at[own]]
        return out


_OPEN: dict[str, object] = WORKER_CACHES.setdefault("models", {})


def _opened(key: str, make):
    """The worker's mapped files of one model; those of an earlier model are let go."""
    if key not in _OPEN:
        for old in [k for k in _OPEN if k.split("|")[0] == key.split("|")[0]]:
            del _OPEN[old]
        _OPEN[key] = make()
    return _OPEN[key]


# ---- training -----------------------------------------------------------------------------------------------------


def _count_words(train: DataFrame, parts: int) -> DataFrame:
    import pyarrow as pa

    def of(batches):
        keys, counts, docs = [], [], 0
        for batch in batches:
            for lo, hi, words, codes, _ in coded(batch.column(0), "ascii", SLICE_BYTES):
                docs += hi - lo
                keys.append(word_hashes(words))
                counts.append(np.bincount(codes, minlength=len(words)).astype(U))
                if sum(map(len, keys)) > FLUSH:
                    k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [c]
        if docs:
            keys.append(word_hashes([END]))
            counts.append(np.array([docs], U))
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            ends = np.searchsorted(_part(k, parts), np.arange(parts + 1))
            full = np.flatnonzero(np.diff(ends)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_blob(k[ends[p] : ends[p + 1]], c[ends[p] : ends[p + 1]]) for p in full], pa.binary())], ["part", "blob"])

    return train.select("text").mapInArrow(thrifty(of, "models"), "part int, blob binary")


def _write_vocabulary(words: DataFrame, base: str, parts: int) -> DataFrame:
    import pandas as pd
    from pyspark import TaskContext

    def merge(key, pdf):
        pairs = [_unblob(b, 2) for b in pdf["blob"]]
        k, c = _summed(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        path = f"{base}/words-{key[0]:06d}-{TaskContext.get().taskAttemptId()}"
        arrays, head = _levels(hash=(k, True), sum=(np.concatenate((np.zeros(1, U), np.cumsum(c, dtype=U))), False))
        write_arrays(path, arrays, **head)
        top = np.argsort(-c.astype(np.int64), kind="stable")[:TOP]
        return pd.DataFrame({"part": [key[0]], "path": [path], "n": [len(k)], "tokens": [int(c.sum())], "top": [top.tolist()], "top_count": [c[top].astype(np.int64).tolist()]})

    return words.groupBy("part").applyInPandas(merge, "part int, path string, n long, tokens long, top array<long>, top_count array<long>")


def _count_trigrams(train: DataFrame, vocabulary_of, layout: Layout) -> DataFrame:
    import pyarrow as pa

    def of(batches):
        vocabulary = vocabulary_of()
        end = int(vocabulary.find(word_hashes([END]))[0][0])
        held, n = [], 0

        def flush():
            nonlocal held, n
            a, b, c = (np.concatenate([h[k] for h in held]) for k in range(3))
            held, n = [], 0
            pair, c = a.astype(U) * U(layout.width) + b.astype(U), c.astype(U)
            if layout.width**3 < 1 << 64:
                whole = np.sort(pair * U(layout.width) + c)
                pair, c = whole // U(layout.width), whole % U(layout.width)
            else:
                order = np.lexsort((c, pair))
                pair, c = pair[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (c[1:] != c[:-1]))))
            times, pair, c = np.diff(np.append(first, len(pair))), pair[first], c[first]
            part = layout.part((pair // U(layout.width)).astype(np.int64), (pair % U(layout.width)).astype(np.int64))
            order = np.argsort(part.astype(np.uint16) if layout.parts <= 65536 else part, kind="stable")
            part, pair, c, times = part[order], pair[order], c[order], times[order]
            ends = np.searchsorted(part, np.arange(layout.parts + 1))
            full = np.flatnonzero(np.diff(ends)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_blob(pair[ends[p] : ends[p + 1]], c[ends[p] : ends[p + 1]], times[ends[p] : ends[p + 1]]) for p in full], pa.binary())], ["part", "blob"])

        for batch in batches:
            for lo, hi, words, codes, starts in coded(batch.column(0), "ascii", SLICE_BYTES):
                ids = vocabulary.find(word_hashes(words))[0]
                stream, _ = _stream(ids[codes] if len(codes) else codes, starts, layout.start, end, layout.pad)
                a, b, c = stream[:-2], stream[1:-1], stream[2:]
                own = (b != layout.start) & (c != layout.start) & (a != layout.pad) & (b != layout.pad)
                held.append((a[own], b[own], c[own]))
                n += int(own.sum())
                if n >= FLUSH:
                    yield flush()
        if n:
            yield flush()

    return train.select("text").mapInArrow(thrifty(of, "models"), "part int, blob binary")


def _stream(ids: np.ndarray, starts: np.ndarray, begin: int, end: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """begin, words, end, pad for each text in turn; and where each text's first word stands."""
    n = np.diff(starts)
    first = starts[:-1] + 3 * np.arange(len(n)) + 1
    out = np.empty(len(ids) + 3 * len(n), np.int64)
    out[first - 1], out[first + n], out[first + n + 1] = begin, end, pad
    out[np.arange(len(ids)) + np.repeat(3 * np.arange(len(n)) + 1, n)] = ids
    return out, first


def _write_tries(grams: DataFrame, base: str, layout: Layout, context_count, keep: int, discount: float) -> DataFrame:
    import pandas as pd
    from pyspark import TaskContext

    width = U(layout.width)

    def merge(key, pdf):
        pair, third, times = (np.concatenate(x) for x in zip(*(_unblob(b, 3) for b in pdf["blob"]), strict=True))
        order = np.lexsort((third, pair))
        pair, third, times = pair[order], third[order], times[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1]))))
        pair, third, times = pair[first], third[first], np.add.reduceat(times, first)
        group = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        pairs, c2 = pair[group], np.add.reduceat(times, group)
        kept = c2 >= keep
        w1 = (pairs // width).astype(np.int64)
        of_pair = np.repeat(np.arange(len(pairs)), np.diff(np.append(group, len(pair))))
        real = third != U(layout.pad)
        total3 = np.bincount(of_pair[real], weights=times[real], minlength=len(pairs))
        good = real & (times >= keep)
        p3 = (times[good] - discount) / total3[of_pair[good]]
        back = 1 - np.bincount(of_pair[good], weights=p3, minlength=len(pairs))
        # first words: all of its followers are here unless it is frequent; then the parts' sums meet on the driver
        words, at = np.unique(w1, return_inverse=True)
        total = context_count(words)
        p2 = (c2 - discount) / np.maximum(total[at], 1)
        mass = np.bincount(at[kept], weights=p2[kept], minlength=len(words))
        hot = np.isin(words, layout.hot)
        # the levels: first words that keep followers; their followers by the word's place; what follows those by the pair's
        there = mass > 0
        place = np.cumsum(there) - 1
        two = place[at[kept]].astype(U) * width + pairs[kept] % width
        node = np.cumsum(kept) - 1
        three = node[of_pair[good]].astype(U) * width + third[good]
        pointers = lambda parents, n: np.concatenate(([0], np.cumsum(np.bincount(parents, minlength=n)))).astype(U)
        n_one, n_two = int(there.sum()), int(kept.sum())
        arrays, head = _levels(one=(words[there].astype(U), True), two=(two, True), three=(three, True), two_at=(pointers(place[at[kept]], n_one), False), three_at=(pointers(node[of_pair[good]], n_two), False))
        log = lambda x: np.log10(np.clip(x, 1e-9, 1))
        for name, x in (("one", log(1 - mass[there])), ("two", np.log10(p2[kept])), ("back", log(back[kept])), ("three", np.log10(p3))):
            arrays[f"{name}_code"], arrays[f"{name}_book"] = quantised(x)
        path = f"{base}/grams-{key[0]:06d}-{TaskContext.get().taskAttemptId()}"
        write_arrays(path, arrays, **head)
        return pd.DataFrame({"part": [key[0]], "path": [path], "pairs": [len(two)], "triples": [len(three)], "hot": [words[hot].tolist()], "mass": [mass[hot].tolist()]})

    return grams.groupBy("part").applyInPandas(merge, "part int, path string, pairs long, triples long, hot array<long>, mass array<double>")


def train_and_score(docs: DataFrame, folds: int = 10, keep: int = 2, discount: float = 0.75, alpha: float = 0.1) -> DataFrame:
    """doc_id, held_out and SCHEMA per row of ``docs`` (doc_id, text): base-10 log probabilities of whole texts.

    Learns from texts whose crc32(doc_id as text) mod ``folds`` is not 0. Tokens: words with A-Z lower-cased, then one end.
    P(w) = (c + alpha) / (N + alpha * (V + 1)); above it, absolute discounting: P(w | u) = (c(u w) - d) / c(u) + back(u) P(w),
    and the same with two words before, where pairs and triples seen less than ``keep`` times only add to what their
    context hands on. All counts are exact and over all training texts; a word is known by its 64-bit hash.

    Each task sorts and sums what it has read and sends each part one compressed run; a part's runs are merged, pruned and
    written as one file of levels: first words, their followers by the word's place, and those of pairs by the pair's, as
    Elias-Fano sequences with one-byte probabilities, and monotone pointers from each level into the next. Parts are as many as shuffle partitions; followers of a frequent word are dealt over several. Scoring maps the files; the
    driver sees their names, sizes and at most 256 word counts a part. Files lie in the shared folder, under names of
    the attempt that wrote them, and only those in the manifest count.

    Null and empty texts: the end alone. Null ids are not trained on; held_out is null. Repeated rows count as often as
    they are there. Without training texts every word is unknown and has the same probability. An empty table gives no
    rows. Other columns are ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.where(crc_fold("doc_id", folds) != 0)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = new_path(spark, "lm")
    make_dirs(spark, base)

    manifest = {r["part"]: r for r in cut(_write_vocabulary(_count_words(train, parts), base, parts), "lm-words").collect()}
    tokens = sum(r["tokens"] for r in manifest.values())
    empty = f"{base}/none"
    arrays, head = _levels(hash=(np.zeros(0, U), True), sum=(np.zeros(1, U), False))
    write_arrays(empty, arrays, **head)
    paths = [manifest[p]["path"] if p in manifest else empty for p in range(parts)]
    sizes = [manifest[p]["n"] if p in manifest else 0 for p in range(parts)]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    open_vocabulary = lambda: _opened(f"words|{base}", lambda: Vocabulary(paths, sizes))
    size = int(offsets[-1])
    n_train = 0
    if tokens:
        n_train = int(Vocabulary(paths, sizes).find(word_hashes([END]))[1][0])
    # words with over a quarter of a part's share, and the start of a text, are dealt over slots
    share = max(1.0, tokens / (4 * parts))
    counts = {int(offsets[p]) + i: c for p, r in manifest.items() for i, c in zip(r["top"], r["top_count"], strict=True) if c > share}
    hot = {w: int(np.ceil(c / share)) for w, c in counts.items()} | {size: max(1, int(np.ceil(n_train / share)))}
    layout = Layout(size, parts, hot)

    def context_count(words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), n_train, np.int64)
        vocabulary = open_vocabulary()
        own = words < size
        part = np.searchsorted(vocabulary.offsets, words[own], side="right") - 1
        found = np.zeros(len(part), np.int64)
        for p in np.unique(part).tolist():
            mine = part == p
            found[mine] = vocabulary.counts(p, words[own][mine] - vocabulary.offsets[p])
        out[own] = found
        return out

    grams, back = [], {}
    if tokens:
        found = cut(_write_tries(_count_trigrams(train, open_vocabulary, layout), base, layout, context_count, keep, discount), "lm-grams").collect()
        none = f"{base}/no-grams"
        blank, start = np.zeros(0, U), np.zeros(1, U)
        arrays, head = _levels(one=(blank, True), two=(blank, True), three=(blank, True), two_at=(start, False), three_at=(start, False))
        codes = {f"{n}_{k}": v for n in ("one", "two", "back", "three") for k, v in zip(("code", "book"), quantised(np.zeros(0)), strict=True)}
        write_arrays(none, arrays | codes, **head)
        by = {r["part"]: r["path"] for r in found}
        grams = [by.get(p, none) for p in range(parts)]
        mass: dict[int, float] = {}
        for r in found:
            for w, m in zip(r["hot"], r["mass"], strict=True):
                mass[w] = mass.get(w, 0.0) + m
        back = {w: float(np.clip(1 - m, 1e-9, 1)) for w, m in mass.items() if m > 0}
    open_model = lambda: _opened(f"grams|{base}", lambda: Model(open_vocabulary(), layout, grams, back))
    unknown = np.log10(alpha / (tokens + alpha * (size + 1)))

    def score(batches):
        vocabulary = open_vocabulary() if tokens else None
        model = open_model() if tokens else None
        end = vocabulary.find(word_hashes([END])) if tokens else None
        for batch in batches:
            for lo, hi, words, codes, starts in coded(batch.column(1), "ascii", SLICE_BYTES):
                n = np.diff(starts) + 1
                if not tokens:
                    made = [n, np.zeros_like(n), np.zeros_like(n), n * unknown, n * unknown]
                else:
                    ids, c = vocabulary.find(word_hashes(words))
                    # the slice's own numbers: its words, then the end, the start and the pad
                    k = len(words)
                    ids = np.concatenate([ids, end[0], [layout.start, layout.pad]])
                    c = np.concatenate([c, end[1], [0, 0]])
                    chance = (c + alpha) / (tokens + alpha * (size + 1))
                    one = np.log10(chance)
                    hand = np.where(ids >= 0, model.backoff(ids), 1.0)
                    stream, first = _stream(codes, starts, k + 1, k, k + 2)
                    token = np.ones(len(stream), bool)
                    token[first - 1] = token[first + n] = False
                    at = np.flatnonzero(token)
                    last, this = stream[at - 1], stream[at]
                    later = stream[at + 1]  # the pad after an end, which no context keeps
                    # a kept pair needs words seen often enough, and a context that hands on less than all
                    often = (ids >= 0) & (c >= keep)
                    known = (hand[last] != 1.0) & often[this]
                    p2, lent, p3 = np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at))
                    own = np.flatnonzero(known)
                    third = np.where(often[later[own]], ids[later[own]], layout.pad)
                    p2[own], lent[own], p3[own] = model.followers(ids[last[own]], ids[this[own]], third)
                    p = p2 + hand[last] * chance[this]
                    # the pair before a token is that of the token before it in its text
                    follow = np.flatnonzero(last != k + 1)
                    p[follow] = p3[follow - 1] + lent[follow - 1] * p[follow]
                    text = np.repeat(np.arange(hi - lo), n)
                    total = lambda x: np.bincount(text, weights=x, minlength=hi - lo)  # noqa: B023,E731
                    made = [n, total(c[this] > 0).astype(np.int64), np.full(hi - lo, tokens), total(one[this]), total(np.log10(p))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, made)], ["doc_id", *[f.split()[0] for f in SCHEMA.split(", ")]])

    out = rows.mapInArrow(thrifty(score, "models"), f"doc_id long, {SCHEMA}")
    return out.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), *[f.split()[0] for f in SCHEMA.split(", ")])


def op7_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), keep=1)  # every pair and every triple
