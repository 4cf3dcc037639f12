"""Words, shingles and their 64-bit hashes, computed with NumPy over whole Arrow batches.

A word's hash is a polynomial in its bytes and a window's hash one in its words' hashes, both
modulo 2**64 and mixed.  Prefix sums give every word and every rolling window in a few passes
over the batch, whatever the words' or windows' lengths are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}

#: Bytes hashed at a time; longer texts are only ever cut between words.  The arrays of a pass
#: take some forty times as much, and the tables of powers stay in memory.
BLOCK = 1 << 20

#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order, by one sort (np.unique may build a hash table of them first)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


def _inverse(base: int, n: int) -> np.ndarray:
    return _powers(pow(base, -1, 1 << 64), n)


class Words:
    """The words of a batch of texts.

    ``raw``: the texts' UTF-8 bytes end to end (unchanged); ``start``, ``end``: each word's
    bytes; ``bounds``: text i has the words bounds[i] to bounds[i + 1]; ``hash``: by word.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, separators=SPACES, fold=SAME, hashed=True):
        self.raw, self.text_bounds = flat_text(texts)
        raw, bounds = self.raw, self.text_bounds
        folded = raw if fold is SAME else fold[raw]
        gap = separators[folded]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        edge = edge[: len(raw)]
        opens = ~gap
        if len(raw):
            before = np.empty(len(raw), bool)
            before[0], before[1:] = True, gap[:-1]
            after = np.empty(len(raw), bool)
            after[-1], after[:-1] = True, gap[1:]
            last = np.zeros(len(raw), bool)
            last[-1], last[:-1] = True, edge[1:]
            self.start = np.flatnonzero(opens & (before | edge))
            self.end = np.flatnonzero(opens & (after | last)) + 1
        else:
            self.start = self.end = np.empty(0, np.int64)
        self.bounds = np.searchsorted(self.start, bounds)
        self.folded = folded
        self.hash = self._hashes(self.end) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    def prefix_hash(self, n_bytes: int) -> np.ndarray:
        """Of each word's first bytes, as if they were a word (the word's own if it is short)."""
        return self._hashes(np.minimum(self.end, self.start + n_bytes))

    def _hashes(self, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(out):
            base = self.start[k]
            upto = max(k + 1, int(np.searchsorted(end, base + BLOCK, "right")))
            part = self.folded[base : end[upto - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[part] * _powers(_BYTE_BASE, len(part)), out=sums[1:])
            s, e = self.start[k:upto] - base, end[k:upto] - base
            out[k:upto] = (sums[e] - sums[s]) * _inverse(_BYTE_BASE, len(part) + 1)[s]
            k = upto
        return mix(out ^ (end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (a word's index) and hash of every window of ``size`` words of one text."""
        n = len(self)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        inside = np.ones(n, bool)
        inside[n - size + 1 :] = False
        ends = self.bounds[1:]
        for k in range(1, size):
            at = ends - k
            inside[at[at >= np.maximum(self.bounds[:-1], 0)]] = False
        starts = np.flatnonzero(inside)
        return starts, self.window_hashes(starts, size)

    def window_hashes(self, starts: np.ndarray, size, base: int = _WORD_BASE) -> np.ndarray:
        """Hashes of the windows at ``starts``; ``size`` may differ by window.  Another odd
        ``base`` gives others."""
        n = len(self)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * _powers(base, max(n, 1))[:n], out=sums[1:])
        h = (sums[starts + size] - sums[starts]) * _inverse(base, n + 1)[starts]
        return mix(h + np.asarray(size, np.uint64))


def flat_text(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the bounds of each; nulls are empty."""
    from .cluster import flat_binary

    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    filled = [c.fill_null("") if c.null_count else c for c in chunks]
    return flat_binary(pa.chunked_array(filled, type=texts.type), np.uint8)


def hex_digest(parts: list[bytes], joined: bytes = b"") -> str:
    import hashlib

    return hashlib.sha256(joined.join(parts)).hexdigest()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK):
    """The batch in runs of rows with about ``limit`` bytes of text (one row at least)."""
    at = batch.schema.get_field_index(column)
    sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    total, first = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            total, first = 0, i
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)
