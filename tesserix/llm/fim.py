"""Fill-in-the-middle: texts cut at two unit boundaries and put together in another order.

A text's units are lines, words or characters.  Whether a unit begins at a byte follows from that
byte and the one before it, so texts are taken apart into chunks of ``CHUNK`` bytes that overlap
by the one byte which that needs, and all chunks of a batch count their boundaries by themselves.
Prefix sums over a text's chunks number its units and so tell which chunk owns the unit at each of
the two cuts; only those chunks are scanned again, for the place.

The Python step takes texts and two numbers a row and gives back three numbers; hashes, forms,
outputs and what is restored from them are Column expressions.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import tidy
from .words import BLOCK, SPACES, flat_text, slices

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

_INSIDE = (np.arange(256) & 0xC0) == 0x80
#: Of each kind of unit: whether one begins at a byte, by the byte before it and itself.
UNITS = {
    "line": lambda before, byte: before == 0x0A,
    "word": lambda before, byte: SPACES[before] & ~SPACES[byte],
    "char": lambda before, byte: ~_INSIDE[byte],
}


class Chunks:
    """The chunks of a batch of texts, with the units and characters that begin in each.

    ``start``, ``end``: a chunk's bytes in ``raw``; ``text``: its text; ``first``: each text's
    first chunk (and the number of chunks); ``units``, ``chars``: how many begin in a text's
    chunks before this one.
    """

    def __init__(self, texts: pa.Array, begins, chunk: int = CHUNK):
        self.raw, bounds = flat_text(texts)
        self.begins, self.bounds = begins, bounds
        counts = -(-np.diff(bounds) // chunk)
        self.first = np.append(0, np.cumsum(counts))
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.start = bounds[self.text] + (np.arange(len(self.text)) - self.first[self.text]) * chunk
        self.end = np.minimum(self.start + chunk, bounds[self.text + 1])
        units, chars = self._counts()
        self.n_units = np.append(0, np.cumsum(units))[self.first]
        self.units, self.chars = (np.append(0, np.cumsum(c))[:-1] for c in (units, chars))
        self.units -= self.n_units[self.text]
        self.chars -= np.append(self.chars, 0)[self.first[self.text]]
        self.n_units = np.diff(self.n_units)

    def marks(self, a: int, b: int) -> np.ndarray:
        """Whether a unit begins at each of the bytes; the first byte of a text begins one."""
        before = self.raw[a - 1 : b - 1] if a else np.append(np.uint8(0), self.raw[: b - 1])
        return self.begins(before, self.raw[a:b])

    def _counts(self) -> tuple[np.ndarray, np.ndarray]:
        units, chars = np.zeros(len(self.text), np.int64), np.zeros(len(self.text), np.int64)
        k = 0
        while k < len(self.text):
            # chunks in their order, as many as have BLOCK bytes together
            upto = max(k + 1, int(np.searchsorted(self.end, self.start[k] + BLOCK, "right")))
            a, b = int(self.start[k]), int(self.end[upto - 1])
            marks, heads = self.marks(a, b), self.start[k:upto] - a
            opening = self.bounds[self.text[k:upto]] == self.start[k:upto]
            marks[heads[opening]] = True
            units[k:upto] = np.add.reduceat(marks, heads, dtype=np.int64)
            chars[k:upto] = np.add.reduceat(~_INSIDE[self.raw[a:b]], heads, dtype=np.int64)
            k = upto
        return units, chars

    def cut(self, text: int, rank: int) -> int:
        """The characters of a text before its unit ``rank``; all of them if it has no such unit."""
        lo, hi = int(self.first[text]), int(self.first[text + 1])
        if lo == hi or rank == 0:
            return 0
        if rank >= self.n_units[text]:
            own, upto = hi - 1, int(self.end[hi - 1])
        else:
            own = lo + int(np.searchsorted(self.units[lo:hi], rank, "right")) - 1
            a = int(self.start[own])
            marks = self.marks(a, int(self.end[own]))
            marks[0] |= own == lo
            upto = a + int(np.flatnonzero(marks)[rank - int(self.units[own])])
        return int(self.chars[own]) + int(np.count_nonzero(~_INSIDE[self.raw[self.start[own] : upto]]))


_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def cuts(unit: str = "line", chunk: int = CHUNK):
    """A function of Columns: text and two non-negative numbers to ``n``, the text's units, and
    ``first`` and ``second``, the characters before the units at the smaller and the larger of the
    numbers modulo n + 1."""
    begins = UNITS[unit]

    @tidy
    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts, one, two], ["text", "one", "two"])):
            chunks = Chunks(part.column("text"), begins, chunk)
            ranks = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two")]) % (chunks.n_units + 1)
            ranks.sort(axis=0)
            for k, (n, a, b) in enumerate(zip(chunks.n_units.tolist(), *ranks.tolist(), strict=True)):
                out.append({"n": n, "first": chunks.cut(k, a), "second": chunks.cut(k, b)})
        return pa.array(out, _CUTS)

    # Spark reads the hints as types, not as the names that a postponed evaluation leaves
    run.__annotations__ = {"texts": pa.Array, "one": pa.Array, "two": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "n long, first long, second long")


def draws(doc_id: Column, seed: str, n: int = 4) -> list[Column]:
    """Numbers below 2**32 that follow from an id and a seed: groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: str = "7", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Each text as prefix, suffix and middle.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A text's cuts, and whether it takes
    part (``rate`` in a hundred do) and in which order (``spm`` in a hundred have the suffix first),
    follow from its id and ``seed``.  Returns a row per input row: ``doc_id, text`` (null as empty),
    ``n`` (units), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars, middle_chars`` (null if
    plain) and ``output``.  Texts that are empty or hold one of the marks are plain, that is, as they
    are; any part of another may be empty.  Texts are cut whole, however long; repeated rows get the
    same values each, rows without an id those of the empty id, and an empty table gives an empty one.
    """
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = draws(F.col("doc_id"), seed)
    cut = named.withColumn("cut", cuts(unit)(F.col("text"), h[0], h[1]))
    held = [F.contains("text", F.lit(m)) for m in marks]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    placed = cut.select(
        "doc_id", "text", F.col("cut.n").alias("n"), form.alias("form"),
        F.col("cut.first").cast("int").alias("first"), F.col("cut.second").cast("int").alias("second"),
    )
    prefix, middle, suffix = (F.expr(f"substring(text, {s})") for s in ("1, first", "first + 1, second - first", "second + 1"))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
    kept = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return placed.select(
        "doc_id", "text", "n", "form", kept(F.col("first")).alias("prefix_chars"), kept(F.col("second") - F.col("first")).alias("middle_chars"),
        output.otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output, told from it and its form alone: no part holds a mark, and a mark
    can't begin inside another."""
    p, s, m = marks
    middle, rest = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    parts = {"psm": (p, s), "spm": (s, p)}
    one, two = {}, {}
    for name, (outer, inner) in parts.items():
        one[name] = F.substring(F.substring_index(rest, inner, 1), F.lit(len(outer) + 1), F.length(rest))
        two[name] = F.substring_index(rest, inner, -1)
    return F.when(form == "psm", F.concat(one["psm"], middle, two["psm"])).when(form == "spm", F.concat(two["spm"], middle, one["spm"])).otherwise(output)
