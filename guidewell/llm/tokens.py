"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WORKER_CACHES

#: Words and stems a worker remembers before it starts afresh (about 150 bytes each).
REMEMBERED = 700_000
#: Text is handled in slices of about so many bytes, so memory does not depend on the batch.
SLICE_BYTES = 8 << 20
#: Marks at the end of a word; both vocabularies cut between a letter and these.
_TAIL = re.compile(r"[.,;:!?]+\Z")
#: A space that follows white space: there the cut before a space is no cut of the tokenizer.
_RUN = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_GAP = re.compile(r"(?<=\S) ")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next free character from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Ids:
    """Ids of numbered words, end to end."""

    def __init__(self):
        self.ids, self.start, self.n, self.words = np.empty(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), 0, 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.n + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.words + len(lengths) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.n : self.n + len(flat)] = flat
        self.start[self.words + 1 : self.words + len(lengths) + 1] = self.n + np.cumsum(lengths)
        self.words += len(lengths)
        self.n += len(flat)

    def gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``k`` end to end, and how many each has."""
        n = self.start[k + 1] - self.start[k]
        before = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(self.start[k] - before[:-1], n) + np.arange(before[-1])], n


class Encoder:
    """``encode(texts)`` gives the same ids as ``Tokenizer.encode_batch(texts, add_special_tokens=False)``, faster.

    Neither vocabulary here has a token across white space, so a text is the sum of its pieces: words between white space
    where the tokenizer drops it (``spaces=False``); with ``spaces=True``, pieces cut before each space that follows none,
    so that each but the first starts with its space. Each distinct piece is encoded once by the tokenizer. Of a plain
    word with marks at its end, letters and marks are encoded apart, which is where the tokenizer cuts; letters alone go
    straight to the tokenizer's model, whose other steps leave them as they are. A test holds the ids against those of
    whole texts. Vocabularies of at most 65,536 ids.
    """

    def __init__(self, path: str, spaces: bool, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces = Tokenizer.from_file(path), spaces
        self.remembered, self.slice_bytes = remembered, slice_bytes
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("a vocabulary of at most 65,536 ids is needed")
        self.letters = {b: c for b, c in byte_letters().items()}
        self.known: dict[str, int] = {}
        self.ids = _Ids()

    def _letters(self, stem: str) -> bool:
        """Whether the tokenizer sees letters alone in the stem, its leading space aside; İ, say, lower-cases to a letter and a mark."""
        word = stem[1:] if self.spaces and stem[:1] == " " else stem
        return word.isalpha() and (self.spaces or word.isascii() or max(word) < "\u0130" or unicodedata.normalize("NFC", word).lower().isalpha())

    def _number(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece: encoded now if it is new. A piece is a stem and a tail; -1 for no tail."""
        known, new, lower = self.known, [], not self.spaces
        out = np.empty((len(pieces), 2), np.int64)
        out[:, 1] = -1
        for k, piece in enumerate(pieces):
            n = known.get(piece)
            if n is None and not piece.isalpha() and (m := _TAIL.search(piece)) and ((stem := piece[: m.start()]).isascii() and stem.isalpha() or self._letters(stem)):
                t = known.get(tail := m[0])
                if t is None:
                    t = known[tail] = len(known)
                    new.append(tail)
                out[k, 1] = t
                piece = stem
                n = known.get(piece)
            if n is None and lower and piece.isascii() and piece.isalpha() and not piece.islower():
                piece = piece.lower()
                n = known.get(piece)
            if n is None:
                n = known[piece] = len(known)
                new.append(piece)
            out[k, 0] = n
        if new:
            self._encode_new(new)
        return out

    def _encode_new(self, new: list[str]) -> None:
        found: list = [None] * len(new)
        rest = []
        model, letters = self.model.tokenize, self.letters
        for k, piece in enumerate(new):
            word = piece[1:] if self.spaces and piece[:1] == " " else piece
            if not word.isalpha() or not word.isascii() and not self.spaces and (not unicodedata.is_normalized("NFC", word) or word.lower() != word):
                rest.append(k)
                continue
            spelt = piece if piece.isascii() and word is piece else piece.encode().decode("latin-1").translate(letters)
            found[k] = [t.id for t in model(spelt)]
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
                found[k] = e.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.ids.extend(np.fromiter((i for f in found for i in f), np.uint16, int(lengths.sum())), lengths)

    def _gather(self, pieces: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at ``codes`` end to end, and how many each has."""
        both = self._number(pieces).ravel()
        keep = both >= 0
        flat, n = self.ids.gather(both[keep])
        lengths = np.zeros(len(both), np.int64)
        lengths[keep] = n
        local = _Ids()
        local.ids, lengths = flat, lengths.reshape(-1, 2).sum(axis=1)
        local.start = np.concatenate(([0], np.cumsum(lengths)))
        return local.gather(codes)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.remembered:
            self.known, self.ids = {}, _Ids()
        texts = pc.fill_null(texts, "")
        if not self.spaces:
            lists = pc.ascii_split_whitespace(texts)
        else:
            lists = pc.split_pattern(texts, " ")
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        pieces, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(per)))
        if self.spaces:
            # a first piece has no space before it; a text in which a space follows white space is cut piece by piece
            first, firsts = starts[:-1], len(pieces)
            slow = np.flatnonzero(pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False))
            head, at = np.unique(codes[first], return_inverse=True)
            codes[first] = firsts + at
            pieces = [" " + p for p in pieces] + [pieces[c] for c in head.tolist()]
            if len(slow):
                per = per.copy()
                parts, extra, number = np.split(codes, starts[1:-1]), [], {}
                for k in slow.tolist():
                    own = [p for p in _GAP.split(texts[k].as_py())]
                    own = [own[0], *[" " + p for p in own[1:]]]
                    parts[k] = np.array([len(pieces) + number.setdefault(p, len(number)) for p in own], np.int64)
                    per[k] = len(own)
                codes, pieces = np.concatenate(parts), pieces + list(number)
                starts = np.concatenate(([0], np.cumsum(per)))
        ids, n = self._gather(pieces, codes)
        ends = np.concatenate(([0], np.cumsum(n)))[starts]
        return ids, np.diff(ends)

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint16), and how many each has; a null text has none."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // self.slice_bytes
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        done = [self._slice(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


_ENCODERS: dict[tuple, Encoder] = WORKER_CACHES.setdefault("tokens", {})


def encoder(path: str, spaces: bool, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> Encoder:
    """The worker's encoder for a vocabulary file; it keeps what it has seen from task to task."""
    key = path, spaces, remembered, slice_bytes
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` appended to each document."""
    total = counts + 1
    out = np.empty(len(flat) + len(counts), flat.dtype)
    last = np.cumsum(total) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep], out[last] = flat, end
    return out, total
