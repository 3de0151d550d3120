"""Quality by nearest-neighbour voting over labelled latent-semantic vectors."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, release, table, thrifty
from .features import coded, examples, logistic_line, logit, owners
from .language_model import word_hashes
from .toxicity import document_frequencies, opened, term_hashes

SCHEMA = "score double, predicted int, neighbours array<struct<doc_id:bigint,similarity:double,label:int>>"
#: Steps of the terms that say how much of a text repeats, shouts or is no letters: one term for each step reached.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)
STATS = ("repeated", "shouted", "marked", "bare", "same")
LENGTHS = (5, 20, 50, 100, 200, 500, 1000, 5000)
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))


def shape(word: str) -> str:
    """A word's outline: runs of capitals A, of other letters a, of digits 0, marks as they are, each run once."""
    word = _RUNS[0][0].sub(lambda m: "A" if m[0].isupper() else "a" if not m[0][0].isupper() else "Aa", word)
    return _RUNS[2][0].sub(_RUNS[2][1], _RUNS[1][0].sub("0", word))


def seen_terms(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Hashes of each word's term (0: none) and of its outline, and the outlines."""
    outlines = [shape(w) for w in words]
    return term_hashes([w.lower() for w in words]), word_hashes(["\n" + s for s in outlines]), outlines


def places(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each hash in an ascending vocabulary, -1 where it is not there."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def step_terms(words, codes, starts, outlines) -> list[tuple[np.ndarray, int]]:
    """(texts, number) of each step of STATS and LENGTHS: the texts of a slice that reach it."""
    n_docs, n = len(starts) - 1, np.diff(starts)
    own, total = owners(starts), np.maximum(n, 1)
    flag = lambda f: np.append(np.array([f(s) for s in outlines], bool), False)[codes]
    share = lambda m: np.bincount(own[m], minlength=n_docs) / total
    three = np.zeros(0, np.uint64)
    inside = np.flatnonzero(own[2:] == own[:-2]) if len(own) > 2 else np.zeros(0, np.int64)
    if len(inside):
        p, c = np.uint64(0xD6E8FEB86659FD93), codes.astype(np.uint64)
        mix = own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c
        three = ((mix[inside] * p ^ c[inside + 1]) * p ^ c[inside + 2]) * p
    _, back, times = np.unique(three, return_inverse=True, return_counts=True)
    again = np.bincount(own[inside[times[back] > 1]], minlength=n_docs) / total
    word_own, per_word = np.unique(own * (len(words) + 1) + codes, return_counts=True)
    top = np.zeros(n_docs)
    np.maximum.at(top, word_own // (len(words) + 1), per_word / total[word_own // (len(words) + 1)])
    stats = [again, share(flag(lambda s: "A" in s and "a" not in s)), share(flag(lambda s: any(c in "#*$%&|<>" for c in s))), share(flag(lambda s: "a" not in s and "A" not in s)), top]
    made = [(np.flatnonzero((x >= step) & (n > 0)), k * len(STEPS) + j) for k, x in enumerate(stats) for j, step in enumerate(STEPS)]
    return made + [(np.flatnonzero(n >= step), len(STATS) * len(STEPS) + j) for j, step in enumerate(LENGTHS)]


N_STEPS = len(STATS) * len(STEPS) + len(LENGTHS)


def quality_rows(docs: DataFrame, vocabulary: np.ndarray, name: str, *more: str) -> DataFrame:
    """(doc_id, int columns ``more``, n, terms): the number of words, and terms with counts as toxicity.term_rows packs them.
    Numbers below the vocabulary's length are its words and outlines, then come the steps; whole texts are read once."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary) + N_STEPS

    def of(batches):
        for batch in batches:
            for lo, hi, words, codes, starts in coded(batch.column(0)):
                own = owners(starts)
                plain, outline, outlines = seen_terms(words)
                pairs = []
                for h in (plain, outline):
                    at = np.append(places(sent.value, h), -1)[codes]
                    pairs.append(own[at >= 0] * size + at[at >= 0])
                pairs += [d * size + len(sent.value) + j for d, j in step_terms(words, codes, starts, outlines)]
                pair, n = np.unique(np.concatenate(pairs), return_counts=True)
                ends, terms = np.searchsorted(pair, np.arange(hi - lo + 1) * size), pair % size
                both = np.diff(terms, prepend=0)
                full = ends[:-1][np.diff(ends) > 0]
                both[full] = terms[full]
                both, n = both.astype("<u4"), n.astype("<u4")
                made = [both[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[1:]], pa.array(np.diff(starts), pa.int32()), pa.array(made, pa.binary())], ["doc_id", *more, "n", "terms"])

    fields = "".join(f"{c} int, " for c in more)
    out = cut(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *more).mapInArrow(thrifty(of), f"doc_id long, {fields}n int, terms binary"), name)
    sent.destroy()
    return out


def example_vocabulary(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and every outline of the examples, ascending, and which of them are words."""
    import pyarrow as pa

    def of(batches):
        for batch in batches:
            for _, _, words, _, _ in coded(batch.column(0)):
                plain, outline, _ = seen_terms(words)
                for word, h in ((True, plain), (False, outline)):
                    h = np.unique(h[h != 0])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), word))], ["h", "word"])

    found = sample.select("text").mapInArrow(of, "h long, word boolean").groupBy("h").agg(F.max("word").alias("word")).toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found["word"].to_numpy()[order]


def _sums(table: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray, step: int = 64) -> np.ndarray:
    """Weighted sums of rows of ``table``, by group: group k has the entries from starts[k] to starts[k + 1]."""
    out = np.zeros((len(starts) - 1, table.shape[1]), table.dtype)
    for a in range(0, len(out), step):
        ends = starts[a : a + step + 1]
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            part = slice(ends[0], ends[-1])
            out[a + full] = np.add.reduceat(table[at[part]] * weight[part, None], ends[:-1][full] - ends[0], axis=0)
    return out


def leading_directions(terms: np.ndarray, weight: np.ndarray, starts: np.ndarray, size: int, dims: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors (size x dims) of sparse rows, by subspace iteration from a fixed random start."""
    weight, wide = weight.astype(np.float32), dims + 8
    order = np.argsort(terms, kind="stable")
    row = owners(starts)[order]
    column_starts = np.searchsorted(terms[order], np.arange(size + 1))
    up = lambda v: _sums(v, terms, weight, starts)
    down = lambda u: _sums(u, row, weight[order], column_starts, 4096)
    v = np.random.default_rng(7).normal(size=(size, wide)).astype(np.float32)
    for _ in range(rounds):
        u, _ = np.linalg.qr(up(v))
        v = down(u)
    w, turn = np.linalg.eigh(v.T.astype(float) @ v)
    top = np.argsort(-w)[:dims]
    scale = np.sqrt(np.maximum(w[top], 1e-30))
    return (v @ (turn[:, top] / scale).astype(np.float32)) * (w[top] > 1e-12 * max(w.max(initial=0), 1e-30))


class QualityModel:
    """Latent directions, and the vectors, labels and class weights of a bounded number of examples."""

    def __init__(self, idf, is_word, ids, y, rows, totals, dims, k, power):
        self.idf, self.is_word, self.ids, self.y, self.k, self.power = idf, is_word, ids, y, k, power
        n = np.array([max(1, int((y == c).sum())) for c in (0, 1)])
        self.class_weight = np.array([totals.get(0, 0), totals.get(1, 0)]) / n
        terms, weight, starts = self.weighted(rows)
        self.turn = leading_directions(terms, weight, starts, len(idf), dims)
        self.examples = self.vectors(rows)
        w = self.class_weight[y] if len(y) else np.zeros(0)
        self.prior = float((w @ y + 0.5) / (w.sum() + 1)) if len(y) else 0.5
        self.line = (1.0, 0.0)
        if len(y):
            votes, _, _ = self.vote(self.examples, leave=True)
            self.line = logistic_line(votes, y, w)

    def weighted(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and weights end to end, and where each text's start. A text's words have length 1 together, and so have its outlines and steps."""
        n, made = rows
        starts = np.concatenate(([0], np.cumsum([len(t) for t, _ in made], dtype=np.int64)))
        terms, counts = (np.concatenate([np.zeros(0, np.int64), *[m[k] for m in made]]) for k in (0, 1))
        own, word = owners(starts), self.is_word[terms]
        outline = ~word & (terms < len(self.idf) - N_STEPS)
        raw = np.where(word, 1 + np.log(counts), np.where(outline, np.log1p(100 * counts / np.maximum(n, 1)[own]), np.log1p(30.0))) * self.idf[terms]
        part = 2 * own + word
        length = np.sqrt(np.bincount(part, weights=raw * raw, minlength=2 * len(made)))
        return terms, raw / np.maximum(length[part], 1e-12), starts

    def vectors(self, rows) -> np.ndarray:
        """Unit latent vectors (zero where a text has no term)."""
        terms, weight, starts = self.weighted(rows)
        x = _sums(self.turn, terms, weight.astype(np.float32), starts).astype(float)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(norm > 0, norm, 1)[:, None]

    def vote(self, x: np.ndarray, leave: bool = False, step: int = 512):
        """Weighted share of label 1 among the k nearest of each vector, by exact products in blocks; and who they are."""
        k = min(self.k, max(1, len(self.y) - leave))
        shares, near, sims = [], [], []
        for a in range(0, len(x), step):
            s = x[a : a + step] @ self.examples.T
            if leave:
                s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
            v = np.take_along_axis(s, top, axis=1)
            order = np.lexsort((top, -v), axis=1)
            top, v = np.take_along_axis(top, order, axis=1), np.take_along_axis(v, order, axis=1)
            w = self.class_weight[self.y[top]] * np.maximum(v, 0) ** self.power
            shares.append(((w * self.y[top]).sum(axis=1) + 0.02 * self.prior) / (w.sum(axis=1) + 0.02))
            near.append(top)
            sims.append(v)
        return np.concatenate(shares), np.concatenate(near), np.concatenate(sims)

    def score(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.y):
            return np.full(len(rows[1]), self.prior), np.zeros((len(rows[1]), 0), int), np.zeros((len(rows[1]), 0))
        votes, near, sims = self.vote(self.vectors(rows))
        return 1 / (1 + np.exp(-(self.line[0] * logit(votes) + self.line[1]))), near, sims


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2048, dims: int = 48, k: int = 24, power: float = 8.0, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out and SCHEMA per row of ``docs`` (doc_id, text), from ``labels`` (doc_id, quality) of training rows alone.

    Terms of a text: its words, their outlines (both of every example, known by 64-bit hashes), and steps of how much of
    it repeats, shouts or is marks. Words together weigh as much as the rest together; inverse document frequencies are
    counted over all of ``docs``, whose whole texts become sparse rows once, which are written. Examples: at most
    ``per_class`` labelled training rows of either class, by hash of the id (with ``dims`` the bound of what is
    broadcast); the ``dims`` latent directions are the leading singular vectors of their rows. Each document's cosines with
    every example are computed in blocks; the ``k`` nearest vote by cosine ** ``power``, weighted back to the classes' true
    shares, on the logistic line that fits the examples when each is left out of its own vote.

    Null and empty texts have a zero vector and the score of no evidence. Null ids: held_out is null. Repeated rows get
    equal scores. One class alone, or no labels: the share of label 1 (0.5 without any). An empty table gives no rows.
    Other columns are never read.
    """
    import pyarrow as pa

    sample, totals = examples(docs, labels, "quality", per_class, folds)
    sample = cut(sample, "quality-examples")
    vocabulary, word = example_vocabulary(sample)
    size = len(vocabulary) + N_STEPS
    known = quality_rows(sample, vocabulary, "quality-example-rows", "y").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    texts = quality_rows(docs, vocabulary, "quality-rows")
    n, found = document_frequencies(texts, size)
    idf = np.log((1 + n) / (1 + found)) + 0.3
    numbers = lambda c: known[c].to_numpy().astype(np.int64)
    model = QualityModel(idf, np.append(word, np.zeros(N_STEPS, bool)), numbers("doc_id"), numbers("y"), (numbers("n"), list(opened(known["terms"]))), totals, dims, k, power)
    del known, vocabulary
    release()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    near_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def of(batches):
        own = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                score, near, sims = own.score((part.column(1).to_numpy(), list(opened(part.column(2)))))
                who = [[{"doc_id": int(own.ids[i]), "similarity": float(s), "label": int(own.y[i])} for i, s in zip(x[:3], v[:3], strict=True)] for x, v in zip(near, sims, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(who, near_type)], ["doc_id", "score", "predicted", "neighbours"])

    scored = texts.mapInArrow(thrifty(of), f"doc_id long, {SCHEMA}")
    return scored.select("doc_id", (crc_fold("doc_id", folds) == 0).alias("held_out"), "score", "predicted", "neighbours")


def op9_lsa_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
