"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, release, table, thrifty
from .features import coded, examples, logistic_line, logit, owners
from .language_model import word_hashes

#: What is not a letter or digit at either end of a word.
ENDS = re.compile(r"^[\W_]+|[\W_]+$")
SCHEMA = "score double, predicted int, evidence array<struct<doc_id:bigint,similarity:double,label:int>>"


class BlockMaxIndex:
    """Inverted index over example vectors in blocks of ids, each with the largest weight a term has in it.

    The few terms that very many examples have stand in a dense table instead: of a batch of queries their part of all
    cosines is one matrix product in single precision, whose error (at most ``slack``) widens the bounds; what may be among
    the nearest is computed again in double precision.
    """

    slack = 2e-5
    #: Lists that together hold at most so many postings an example are read whole, without bounds.
    short = 24

    def __init__(self, n: int, ex: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, block: int = 64, most_dense: int = 256, dense_share: float = 0.125):
        """``ex``, ``term``, ``weight``: an entry for each term of each of ``n`` examples; an example's weights have length 1 together."""
        self.n, self.block, self.n_blocks = n, block, n // block + 1
        often = np.bincount(term, minlength=n_terms)
        dense = np.argsort(-often, kind="stable")[:most_dense]
        dense = np.sort(dense[often[dense] > dense_share * self.n])
        self.column = np.full(n_terms, -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        place = self.column[term]
        own = place >= 0
        self.table = np.zeros((self.n, len(dense)))
        self.table[ex[own], place[own]] = weight[own]
        self.coarse = np.zeros((len(dense), self.n_blocks * block), np.float32)
        self.coarse[:, : self.n] = self.table.T
        del place
        np.logical_not(own, out=own)
        ex, weight, term = ex[own].astype(np.int32), weight[own], term[own].astype(np.int32)
        del own
        order = term.astype(np.int64)
        order *= max(1, n)
        order += ex
        order = np.argsort(order)
        ex, weight, term = ex[order], weight[order], term[order]
        del order
        self.ex, self.weight, self.start = ex, weight, np.searchsorted(term, np.arange(n_terms + 1, dtype=np.int32)).astype(np.int32)
        group = ex // block
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])))[: len(ex)]).astype(np.int32)
        self.best = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        self.at = np.append(first, len(ex)).astype(np.int32)
        self.blocks = group[first]
        self.block_start = np.searchsorted(term[first], np.arange(n_terms + 1, dtype=np.int32)).astype(np.int32)

    def _sums(self, at, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Parts of the cosines of all examples over postings ``at`` (places, or slices), ``n`` of them in turn with the query weight ``w``; terms add up in one order."""
        if isinstance(at, np.ndarray):
            ex, weight = self.ex[at], self.weight[at]
        elif at:
            ex, weight = np.concatenate([self.ex[s] for s in at]), np.concatenate([self.weight[s] for s in at])
        else:
            ex, weight = self.ex[:0], self.weight[:0]
        return np.bincount(ex, weights=np.repeat(w, n) * weight, minlength=self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, batch: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the k examples of largest cosine above 0, ties by example; exact: a block is left out only if its bound is below the k-th best."""
        out = []
        for a in range(0, len(queries), batch):
            part = queries[a : a + batch]
            dense = np.zeros((len(part), self.table.shape[1]))
            for i, (t, w) in enumerate(part):
                c = self.column[t]
                dense[i, c[c >= 0]] = w[c >= 0]
            common = dense.astype(np.float32) @ self.coarse
            out += [self._nearest(t, w, dense[i], common[i], k) for i, (t, w) in enumerate(part)]
        return out

    def _nearest(self, terms, weights, dense, common, k):
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        length = self.start[terms + 1] - self.start[terms]
        if length.sum() <= self.short * self.n:  # short lists are read faster than their bounds
            sums = self._whole(terms, length, weights)
            near = sums + common[: self.n]
            least = self._least(near, k)
        else:
            sums, near, least = self._by_blocks(terms, weights, length, common, k)
        ids = np.flatnonzero((near > 0) & (near >= least))
        sums = sums[ids] + np.einsum("ij,j->i", self.table[ids], dense)
        ids, sums = ids[sums > 0], sums[sums > 0]
        order = np.lexsort((ids, -sums))[:k]
        return ids[order], sums[order]

    def _least(self, near: np.ndarray, k: int) -> float:
        """What every one of the k nearest reaches, the error of the dense part allowed for."""
        return max(0.0, np.partition(near, self.n - k)[self.n - k] - 2 * self.slack) if self.n > k else 0.0

    def _whole(self, terms, length, weights) -> np.ndarray:
        return self._sums([slice(x, y) for x, y in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True)], length, weights)

    def _by_blocks(self, terms, weights, length, common, k):
        a, b = self.block_start[terms], self.block_start[terms + 1]
        entry = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange((b - a).sum())
        block, w = self.blocks[entry], np.repeat(weights, b - a)
        bound = np.bincount(block, weights=w * self.best[entry], minlength=self.n_blocks) + common.reshape(self.n_blocks, self.block).max(axis=1)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        common = common[: self.n].astype(np.float64)
        chosen = np.zeros(self.n_blocks, bool)
        chosen[order[:4]] = True
        while True:
            if 2 * np.count_nonzero(chosen) > len(order):  # most blocks: whole lists are read faster than their parts
                sums = self._whole(terms, length, weights)
                return sums, sums + common, self._least(sums + common, k)
            own = entry[chosen[block]]
            n = (self.at[own + 1] - self.at[own]).astype(np.int64)
            sums = self._sums(np.repeat(self.at[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()), n, w[chosen[block]])
            near = np.where(np.repeat(chosen, self.block)[: self.n], sums + common, 0.0)
            least = self._least(near, k)
            more = (bound > 0) & (bound >= least - self.slack) & ~chosen
            if not more.any():
                return sums, near, least
            chosen |= more


class ToxicityModel:
    """What scoring needs: terms, their weights, the index, labels and class weights of at most 2 * per_class examples."""

    def __init__(self, idf, ids, y, rows, totals, k, power, calibrate):
        self.idf, self.ids, self.y, self.k, self.power, self.calibrate = idf, ids, y, k, power, calibrate
        n = np.array([max(1, int((y == c).sum())) for c in (0, 1)])
        self.class_weight = np.array([totals.get(0, 0), totals.get(1, 0)]) / n  # examples stand for all labelled rows of their class
        terms, counts, starts = rows
        ex = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
        weight = np.log(counts)
        weight += 1
        weight *= idf[terms]
        weight /= np.sqrt(np.bincount(ex, weights=weight * weight, minlength=len(y)))[ex]
        self.index = BlockMaxIndex(len(y), ex, terms, weight, len(idf))
        w = self.class_weight[y]
        blank = np.diff(starts) == 0
        rate = lambda m: float((w[m] @ y[m] + 1e-3) / (w[m].sum() + 1e-2)) if len(y) else 0.1
        self.prior = rate(np.ones(len(y), bool))
        self.blank = rate(blank) if blank.any() else self.prior  # of texts that share no term with the vocabulary
        self.seen: dict[bytes, tuple] = {}
        self.line = self._calibrate(terms, weight, starts)

    def _calibrate(self, terms: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[float, float]:
        """Slope and offset of a logistic line from votes to labels, fitted on examples (``calibrate`` at most, evenly taken) whose own vote is left out."""
        own = np.flatnonzero(np.diff(starts))
        own = own[:: len(own) // self.calibrate + 1].tolist()
        near = self.index.nearest_of([(terms[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]]) for i in own], self.k + 1)
        votes = [self._share(ids[ids != i][: self.k], sims[ids != i][: self.k]) for i, (ids, sims) in zip(own, near, strict=True)]
        y = self.y[own] if own else np.zeros(0, np.int64)
        return logistic_line(np.array(votes), y, self.class_weight[y])

    def _share(self, ids: np.ndarray, sims: np.ndarray) -> float:
        vote = self.class_weight[self.y[ids]] * sims**self.power
        return float((vote @ self.y[ids] + 0.02 * self.prior) / (vote.sum() + 0.02))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt(w @ w)
        return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int, list]]:
        """Score, prediction and the three nearest of texts given as terms and counts; texts seen before are not searched again."""
        if len(self.seen) > 8_000:
            self.seen.clear()
        vectors = [self.vector(*r) for r in rows]
        keys = [blake2b(t.tobytes() + w.tobytes(), digest_size=16).digest() if len(t) else None for t, w in vectors]
        todo = {key: v for key, v in zip(keys, vectors, strict=True) if key and key not in self.seen}
        for key, (ids, sims) in zip(todo, self.index.nearest_of(list(todo.values()), self.k), strict=True):
            score = float(1 / (1 + np.exp(-(self.line[0] * logit(self._share(ids, sims)) + self.line[1]))))
            self.seen[key] = score, int(score >= 0.5), [(int(self.ids[i]), float(s), int(self.y[i])) for i, s in zip(ids[:3], sims[:3], strict=True)]
        blank = self.blank, int(self.blank >= 0.5), []
        return [self.seen[key] if key else blank for key in keys]


def bare(words) -> list[str]:
    """Words without the punctuation and symbols at their ends."""
    return [w if w[:1].isalnum() and w[-1:].isalnum() else ENDS.sub("", w) for w in words]


def term_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the bare words, by which terms are known; 0 for words of punctuation alone, which are none."""
    terms = bare(words)
    return np.where(np.array([bool(t) for t in terms], bool), word_hashes(terms), np.uint64(0))


def counted(texts, vocabulary: np.ndarray):
    """Yield (lo, hi, terms, counts, ends) for slices of a text column: each text's distinct terms as numbers in an ascending
    vocabulary of term hashes, ascending, and how often it has them."""
    size = max(1, len(vocabulary))
    for lo, hi, words, codes, starts in coded(texts, "utf8"):
        h = term_hashes(words)
        at = np.minimum(np.searchsorted(vocabulary, h), size - 1)
        at = np.where(vocabulary[at] == h, at, -1) if len(vocabulary) else np.full(len(h), -1)
        at = np.append(at, -1)[codes]
        hit = at >= 0
        pair, n = np.unique(owners(starts)[hit] * size + at[hit], return_counts=True)
        yield lo, hi, pair % size, n, np.searchsorted(pair, np.arange(hi - lo + 1) * size)


def example_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every term of the examples, ascending, with the number of examples of label 0 and of label 1 that have it."""
    import pyarrow as pa

    def of(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, hi, words, codes, starts in coded(batch.column(0), "utf8"):
                if not len(codes):
                    continue
                terms, back = np.unique(term_hashes(words), return_inverse=True)
                pair = np.unique(owners(starts) * len(terms) + back[codes])
                n = [np.bincount(pair[y[lo:hi][pair // len(terms)] == c] % len(terms), minlength=len(terms)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *[pa.array(x, pa.int64()) for x in n]], ["term", "n0", "n1"])

    df = sample.select("text", "y").mapInArrow(of, "term long, n0 long, n1 long").where("term <> 0").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = df.toArrow()
    terms = found["term"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    return terms[order], np.stack([found[c].to_numpy()[order] for c in ("n0", "n1")])


def telling(n: np.ndarray, a: int, b: int, floor: float, full_z: float) -> np.ndarray:
    """Factor of each term's weight, ``floor`` to ``floor`` + 1: by the standard errors (``full_z`` of them for all) that part label 1 from label 0."""
    if not a or not b:
        return np.ones(n.shape[1])
    p = n.sum(axis=0) / (a + b)
    z = (n[1] / b - n[0] / a) / np.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)
    return floor + np.clip(z / full_z, 0, 1) ** 2


def term_rows(docs: DataFrame, vocabulary: np.ndarray, name: str, *more: str) -> DataFrame:
    """(doc_id, int columns ``more``, terms): per row the numbers of its distinct terms of a vocabulary (as differences) and
    then how often it has each, as little-endian unsigned 32-bit integers; whole texts are read once, and the rows written."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches):
        for batch in batches:
            for lo, hi, terms, n, ends in counted(batch.column(0), sent.value):
                both = np.diff(terms, prepend=0)
                both[ends[:-1][np.diff(ends) > 0]] = terms[ends[:-1][np.diff(ends) > 0]]
                both, n = both.astype("<u4"), n.astype("<u4")
                made = [both[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[1:]], pa.array(made, pa.binary())], ["doc_id", *more, "terms"])

    fields = "".join(f"{c} int, " for c in more)
    out = cut(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *more).mapInArrow(thrifty(of), f"doc_id long, {fields}terms binary"), name)
    sent.destroy()
    return out


def opened(column):
    """Yield the terms and counts of each row of a column that term_rows made."""
    for data in column:
        both = np.frombuffer(data.as_py(), "<u4").astype(np.int64)
        half = len(both) // 2
        yield np.cumsum(both[:half]), both[half:]


def document_frequencies(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of rows, and of rows that have each term of a vocabulary; each task sends its sums once."""
    import pyarrow as pa

    def of(batches):
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a in range(0, batch.num_rows, 1024):
                terms = [t for t, _ in opened(batch.column(0).slice(a, 1024))]
                total += np.bincount(np.concatenate(terms), minlength=size)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1), pa.int32()), pa.array(np.append(total[t], n), pa.int64())], ["t", "n"])

    found = rows.select("terms").mapInArrow(of, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n, out = found["t"].to_numpy(), found["n"].to_numpy(), np.zeros(size, np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), out


def example_counts(sample: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Ids and labels of the examples, by id; and their terms and counts end to end, with where each example's start."""
    rows = term_rows(sample, vocabulary, "example-terms", "y").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    made = [[x.astype(np.int32) for x in pair] for pair in opened(rows["terms"])]
    starts = np.concatenate(([0], np.cumsum([len(m[0]) for m in made], dtype=np.int64)))
    terms = np.concatenate([np.zeros(0, np.int32), *[m[0] for m in made]])
    counts = np.concatenate([np.zeros(0, np.int32), *[m[1] for m in made]])
    return rows["doc_id"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64), (terms, counts, starts)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4096, floor: float = 0.02, full_z: float = 5.0, k: int = 32, power: float = 2.0, folds: int = 5, calibrate: int = 2048) -> DataFrame:
    """doc_id, held_out and SCHEMA per row of ``docs`` (doc_id, text), from ``labels`` (doc_id, toxic) of training rows alone.

    Examples: at most ``per_class`` labelled training rows of either class, by hash of the id (the bound of what is
    broadcast); their votes are weighted back to the classes' true shares. Vocabulary: every term of the examples. A
    term, known by a 64-bit hash, weighs (1 + ln count) * idf, times a factor that rises from ``floor`` with how much it tells label 1 (telling);
    no term has weight 0. Whole texts are read once and written as sparse rows, over all of which the inverse document
    frequencies are counted. A document's score is the share of label 1 among its ``k`` nearest examples by cosine, weighted by
    cosine ** ``power`` and shrunk towards the share of all, on the logistic line that fits the labels of ``calibrate``
    examples at most when each is left out of its own vote; evidence names the three nearest.

    Null and empty texts, and texts without a term of any example: the share of label 1 among examples without one.
    Null ids: held_out is null. Repeated rows get equal scores. No labels at all: 0.1 for every row. An empty table gives
    no rows. Other columns, among them lang, source and labels in ``docs``, are never read.
    """
    import pyarrow as pa

    sample, totals = examples(docs, labels, "toxic", per_class, folds)
    sample = cut(sample, "toxicity-examples")
    terms, found = example_terms(sample)
    ids, y, rows = example_counts(sample, terms)
    texts = term_rows(docs, terms, "toxicity-terms")
    n, df = document_frequencies(texts, len(terms))
    weight = (np.log((1 + n) / (1 + df)) + 1) * telling(found, int((y == 0).sum()), int((y == 1).sum()), floor, full_z)
    model = ToxicityModel(weight, ids, y, rows, totals, k, power, calibrate)
    del terms, found, rows, df, weight
    release()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    del model
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def of(batches):
        own = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                made = own.score(list(opened(part.column(1))))
                near = [[{"doc_id": d, "similarity": s, "label": y} for d, s, y in m[2]] for m in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.int32()), pa.array(near, evidence)], ["doc_id", "score", "predicted", "evidence"])

    scored = texts.mapInArrow(thrifty(of), f"doc_id long, {SCHEMA}")
    return scored.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), "score", "predicted", "evidence")


def op4_blockmax_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
