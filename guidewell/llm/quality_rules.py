"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from .common import SPACES, table, thrifty, words_of

SYMBOLS = "#*$%&|<>"
#: Bands by UTF-8 length: up to so many bytes, a ratio (bytes / compressed bytes) must lie within [low, high]. Prose of
#: that length at level 3 lies well inside; longer text compresses better, so limits rise with length.
BANDS: tuple[tuple[float, float, float], ...] = (
    (256, 0.85, 2.00),
    (512, 1.15, 2.10),
    (1024, 1.25, 2.17),
    (2048, 1.40, 2.25),
    (4096, 1.55, 2.35),
    (8192, 1.65, 2.45),
    (16384, 1.70, 2.55),
    (32768, 1.75, 2.62),
    (131072, 1.80, 2.75),
    (float("inf"), 1.80, 3.20),
)
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
SCHEMA = f"{BASE}, ratio double, chunks long, bad_chunks long, reason string, kept boolean"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for null."""
    words = words_of(text)
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)) if text else 0, 0, 0)
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found, last = Counter(windows), -1
        for k, window in enumerate(windows):
            if found[window] > 1:
                repeated += k + 2 - max(last, k - 1)
                last = k + 2
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines), repeated)


class Bands:
    """Ratio limits by length, and the verdict on a text."""

    def __init__(self, bands=BANDS, level: int = 3, chunk: int = 4096, bad_share: float = 0.05):
        import zstandard

        self.edges, self.limits = [b[0] for b in bands], [b[1:] for b in bands]
        self.chunk, self.bad_share = chunk, bad_share
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress

    def side(self, data: bytes) -> tuple[float, int]:
        """Ratio, and -1 below, 0 inside, 1 above the limits of that length."""
        ratio = len(data) / len(self.compress(data))
        low, high = self.limits[bisect_left(self.edges, len(data))]
        return ratio, -1 if ratio < low else int(ratio > high)

    def verdict(self, data: bytes) -> tuple[float | None, int, int, str | None]:
        """ratio, chunks, bad chunks, and why it is rejected (null: it is not). Shares of chunks count by bytes."""
        if not data:
            return None, 0, 0, "empty"
        ratio, side = self.side(data)
        if len(data) <= self.chunk:
            return ratio, 1, int(side != 0), {-1: "incompressible", 0: None, 1: "repetitive"}[side]
        sides = [(self.side(part)[1], len(part)) for part in (data[k : k + self.chunk] for k in range(0, len(data), self.chunk))]
        bad = [n for s, n in sides if s]
        why = {-1: "incompressible", 0: None, 1: "repetitive"}[side]
        if why is None and sum(bad) > self.bad_share * len(data):
            why = "chunks"
        return ratio, len(sides), len(bad), why


def rule(text: str | None, bands: Bands, min_words: int = 50, max_repeat: float = 0.5) -> tuple:
    counts = base_counts(text)
    failed = counts[0] < min_words or counts[4] > max_repeat * counts[0]
    ratio, chunks, bad, why = bands.verdict(text.encode("utf-8", "surrogatepass") if text else b"")
    return (*counts, failed, ratio, chunks, bad, "base" if failed else why, not failed and why is None)


def quality_rules(docs: DataFrame, bands=BANDS, level: int = 3, chunk: int = 4096, bad_share: float = 0.05, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Add the columns of SCHEMA to ``docs``, which has ``text``: base counts, ratio, chunk verdicts and ``kept``.

    A text is kept if it has ``min_words`` words, at most ``max_repeat`` of them in repeated 3-word windows, a whole-text
    ratio within the limits of its length, and at most ``bad_share`` of its bytes in chunks whose ratio is outside the
    limits of the chunk's length. Each row is judged alone, in one pass without exchange; memory is one Arrow batch.

    Nulls and empty texts: no words, ratio null, base fails, not kept. Very long texts: chunk by chunk, whole. Repeated
    rows get the same answer each. An empty table gives no rows. Columns of ``docs`` named as those of SCHEMA are replaced.
    """
    import pandas as pd

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    docs = docs.select([docs[c] for c in docs.columns if c not in names])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def judge(batches):
        own = Bands(bands, level, chunk, bad_share)
        for pdf in batches:
            made = pd.DataFrame([rule(t, own, min_words, max_repeat) for t in pdf["text"]], columns=names, index=pdf.index)
            yield pd.concat([pdf, made], axis=1)

    return docs.mapInPandas(thrifty(judge), ", ".join([*fields, SCHEMA]))


def op5_compression_bands(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[part.split()[0] for part in SCHEMA.split(", ")])
