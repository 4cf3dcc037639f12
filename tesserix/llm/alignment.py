"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level BPE tokenizer and side B a piece tokenizer with byte fallback, which puts a
space before a text and writes spaces as U+2581.  Both are given the text with a space before it.
Offsets at which tokens of both sides end cut the text into groups, and two tokens that end at
one offset are linked.  The count of an id pair is how many links of the whole corpus hold it.

Neither side's tokens cross a single space that stands between two other characters (of side B's
pieces that is checked), so a text is taken apart there into *units*, each of which has its tokens,
groups and links by itself.  A task keeps those of units it has met.

Counts travel by side B's ids.  A scan writes, for each *lot* of documents, how often each document
has each pair, sorted by pair and packed, a message for each of ``PARTS`` parts of the ids.  Pairs'
counts are added up beside that.  Both then meet, part by part: a task reads a sorted stream that
Spark spills where it must, first the counts of the part's pairs, of which it takes each B id's
highest, then the messages one at a time, for which it gives what each document gets.  A part
whose ids are so frequent that it has many messages is dealt over several tasks, which
all read its counts.  What the parts give is added up by lot, next to the lot's own rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_symbols, _gathered, _Numbers
from .cluster import checkpointed, tidy
from .words import BLOCK, mix, slices

#: Parts of side B's ids.
PARTS = 32
#: Links of a lot of documents, and documents in it, after which another is begun.
LOT_LINKS, LOT_DOCS = 1 << 21, 1 << 14
#: (document, pair) entries of a part that one task takes: a share of all, between these bounds.
TASK_ENTRIES = (1 << 16, 1 << 25)
#: Pairs whose counts a task adds up before it passes them on, and pairs that travel as one row.
PAIRS_AT_A_TIME, PACKED = 1 << 21, 1 << 18
#: Units that a worker keeps, and characters of them all; units handled at a time.
KEPT_UNITS, KEPT_CHARS, TOGETHER = 600_000, 16_000_000, 200_000

#: From the start or a single space between two characters that aren't white space up to the next.
_UNITS = re.compile(r"\s*\S+(?:(?! \S)\s+(?:\S+|\Z))*|\s+")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Sides:
    """Both tokenizers: ids of texts that begin with a space, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = _byte_symbols()
        self.bytes_a = {i: bytes(symbols[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in symbols for c in t)}
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            own = _BYTE_PIECE.fullmatch(piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(own[1], 16)]) if own else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece of side B goes across a space between other characters")
        self.width = 1 + max(self.bytes_a)
        self.sizes_a, self.sizes_b = np.zeros(self.width, np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        for i, x in self.bytes_a.items():
            self.sizes_a[i] = len(x)
        # an id's digits and what follows them: in a group of side A or B, and at the end of one
        self.digits = np.array([f"{i}{end}" for ids, ends in ((self.width, ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(ids)], object)
        if self.width * len(self.bytes_b) >> 42:
            raise ValueError("the vocabularies have over 2**42 pairs of ids")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        return a, self.b.encode([u[1:] for u in units], num_threads=1)


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> Sides:
    """Read once a worker."""
    return Sides(path_a, path_b)


class Aligner:
    """Tokens, groups and links of texts, by way of their units, which are kept from task to task.

    A unit's ``counts`` are its tokens of A and of B, its groups and whether the tokens' bytes are the
    unit's (it has no groups else); its links, as pair keys (B's id times A's width and A's id), are a stretch of ``pool``.
    """

    def __init__(self, of: Sides):
        self.sides = of
        self._forget()

    def _forget(self) -> None:
        self.known, self.chars = _Numbers(), 0
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)
        self.pool, self.bounds = np.empty(0, np.int64), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Align the units that are numbered but not known yet, all at once: their bytes lie end to end,
        so offsets at which tokens of both sides end are found by one search."""
        units = list(islice(self.known, len(self.groups), None))
        if not units:
            return
        self.chars += sum(map(len, units))
        of, n = self.sides, len(units)
        sides = self.sides.encode(units)
        counts = np.array([[len(x) for x in ids] for ids in sides], np.int64)
        raw = [u.encode() for u in units]
        tables = (of.bytes_a, of.bytes_b)
        good = np.ones(n, bool)
        if any(b"".join([table[i] for x in ids for i in x]) != b"".join(raw) for ids, table in zip(sides, tables, strict=True)):
            for k in range(n):
                good[k] = all(b"".join([table[i] for i in ids[k]]) == raw[k] for ids, table in zip(sides, tables, strict=True))
        ids = [np.array([i for x, ok in zip(own, good.tolist(), strict=True) if ok for i in x], np.int64) for own in sides]
        ends = [np.cumsum(sizes[own]) for own, sizes in zip(ids, (of.sizes_a, of.sizes_b), strict=True)]
        # each token's group, and whether it is its last
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in group]
        unit_ends = np.cumsum(np.where(good, [len(x) for x in raw], 0))
        upto = np.searchsorted(cuts, unit_ends, "right")
        n_groups = np.diff(np.append(0, upto))
        keys = ids[1][last[1]] * of.width + ids[0][last[0]]
        # all tokens, by group and side, as text
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        first_b = 2 * of.width
        spelt = np.concatenate([ids[0] + of.width * last[0], first_b + ids[1] + len(of.bytes_b) * last[1]])[order]
        text = of.digits[spelt].tolist()
        bounds = np.append(0, np.cumsum(np.where(good, counts.sum(axis=0), 0))).tolist()
        self.groups += ["".join(text[a:b]) for a, b in zip(bounds, bounds[1:])]
        self.counts = np.concatenate([self.counts, np.stack([counts[0], counts[1], n_groups, good], axis=1)])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(n_groups))
        self.pool = np.append(self.pool, keys)

    def align(self, texts: list[str]):
        """Of each text (tokens of A, of B, groups, the groups' digest or '', pair keys of its links)."""
        if len(self.known) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self._forget()
        numbers = []
        for text in texts:
            known = self.known
            numbers.append([known[u] for u in _UNITS.findall(" " + text)] if text else [])
        self._learn()
        for own in numbers:
            at = np.array(own, np.int64)
            n_a, n_b, n_groups, n_good = self.counts[at].sum(axis=0).tolist()
            if not own or n_good < len(own):
                yield 0, 0, 0, "", np.empty(0, np.int64)
                continue
            digest = hashlib.sha256()
            for k in range(0, len(own), TOGETHER):
                spelt = "".join([self.groups[u] for u in own[k : k + TOGETHER]])
                # each group has a semicolon behind it, which the last one goes without
                digest.update((spelt if k + TOGETHER < len(own) else spelt[:-1]).encode())
            yield n_a, n_b, n_groups, digest.hexdigest(), _gathered(self.pool, self.bounds, at)[0]


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One a worker, as most of a task's units were in others."""
    return Aligner(sides(path_a, path_b))


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, dtype, n: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(pa.decompress(data, n * dtype.itemsize, "zstd", asbytes=True), dtype)


def part_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(PARTS)).astype(np.int64)


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_DOC_DDL = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
#: A lot's documents in one row, and a row for each part of its pairs: ``pairs`` ascending with the number of
#: documents of each (``per_pair``), and those documents (places in the lot) with how often they have it.
_SCANNED = f"lot string, docs array<{_DOC_DDL}>, part long, n_pairs long, n_entries long, pairs binary, per_pair binary, places binary, times binary"
_NAMES = [f.split()[0] for f in re.sub(r"<.*?>>", "", _SCANNED).split(", ")]


def _messages(lot: str, docs: list[dict], keys: list[np.ndarray], width: int):
    """The rows of a lot."""
    nothing = [None] * len(_NAMES)
    yield dict(zip(_NAMES, nothing, strict=True)) | {"lot": lot, "docs": docs}
    place = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    both = np.concatenate(keys) << np.int64(20) | place if keys else np.empty(0, np.int64)
    both.sort()
    heads = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
    times = np.diff(np.append(heads, len(both)))
    both = both[heads]
    pair, place = both >> 20, both & ((1 << 20) - 1)
    part = part_of(pair // width)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(PARTS + 1))
    for k in range(PARTS):
        own = order[bounds[k] : bounds[k + 1]]
        if len(own):
            p = pair[own]
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            yield dict(zip(_NAMES, nothing, strict=True)) | {
                "lot": lot, "part": k, "n_pairs": len(first), "n_entries": len(own), "pairs": _packed(p[first]),
                "per_pair": _packed(np.diff(np.append(first, len(p)))), "places": _packed(place[own].astype(np.int32)), "times": _packed(times[own]),
            }


_FIELDS = pa.schema([
    ("lot", pa.string()), ("docs", pa.list_(_DOC)), ("part", pa.int64()), ("n_pairs", pa.int64()), ("n_entries", pa.int64()),
    ("pairs", pa.binary()), ("per_pair", pa.binary()), ("places", pa.binary()), ("times", pa.binary()),
])


def _scan(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    @tidy
    def run(batches):
        aligner, number, rows, keys, links = aligner_of(path_a, path_b), 0, [], [], 0
        task, width = TaskContext.get().partitionId(), aligner.sides.width

        def told():
            for row in _messages(f"{task}-{number}", rows, keys, width):
                yield pa.RecordBatch.from_pylist([row], _FIELDS)

        for batch in batches:
            for part in slices(batch, limit=BLOCK):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, (a, b, g, digest, own) in zip(part.column("doc_id").to_pylist(), aligner.align(texts), strict=True):
                    rows.append({"doc_id": doc_id, "n_a": a, "n_b": b, "n_groups": g, "n_links": len(own), "groups_sha256": digest})
                    keys.append(own)
                    links += len(own)
                    if links >= LOT_LINKS or len(rows) >= LOT_DOCS:
                        yield from told()
                        number, rows, keys, links = number + 1, [], [], 0
        if rows:
            yield from told()

    return docs.select("doc_id", "text").mapInArrow(run, _SCANNED)


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, the pair (its index) of each entry, its document's place and its times."""
    n, m = row["n_pairs"], row["n_entries"]
    of = np.repeat(np.arange(n), _unpacked(row["per_pair"], np.int64, n))
    return _unpacked(row["pairs"], np.int64, n), of, _unpacked(row["places"], np.int32, m), _unpacked(row["times"], np.int64, m)


@tidy
def _task_counts(batches):
    """A task's pairs and how many links hold each, several times if there are many pairs."""
    seen, waiting = [], 0

    def told():
        keys, index = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, index, np.concatenate([c for _, c in seen]))
        return keys, total

    for batch in batches:
        for row in batch.to_pylist():
            pairs, of, _, times = _entries(row)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, of, times)
            seen.append((pairs, total))
            waiting += len(pairs)
            if waiting > PAIRS_AT_A_TIME:
                seen = [told()]
                waiting = len(seen[0][0])
                if waiting > PAIRS_AT_A_TIME // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in seen[0]], ["pair", "links"])
                    seen, waiting = [], 0
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in told()], ["pair", "links"])


def _counted(scanned: DataFrame) -> DataFrame:
    """``pair, links`` over the corpus."""
    messages = scanned.where("part IS NOT NULL").select("n_pairs", "n_entries", "pairs", "per_pair", "places", "times")
    return messages.mapInArrow(_task_counts, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, links, best`` of every linked id pair: its count, and whether it is the highest of its
    B id (ties included).  Takes ``doc_id`` and ``text``."""
    from pyspark.sql import Window

    width = sides(path_a, path_b).width
    counted = _counted(checkpointed(_scan(docs, path_a, path_b)))
    split = counted.select((F.col("pair") % width).cast("int").alias("a"), F.floor(F.col("pair") / width).cast("int").alias("b"), "links")
    # at most as many rows of a B id as side A has ids
    return split.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


_STREAM = "part long, task int, step int, lot string, n_pairs long, n_entries long, pairs binary, per_pair binary, places binary, times binary"


def _packed_counts(width: int):
    """Counts by part, ``PACKED`` pairs a row at most, as rows of the stream."""

    def told(keys, links):
        part = part_of(keys // width)
        for k in np.unique(part).tolist():
            own = part == k
            yield {"part": k, "step": 0, "n_pairs": int(own.sum()), "pairs": _packed(keys[own]), "times": _packed(links[own])}

    @tidy
    def run(batches):
        keys, links, waiting = [], [], 0
        for batch in batches:
            keys.append(batch.column("pair").to_numpy())
            links.append(batch.column("links").to_numpy())
            waiting += batch.num_rows
            if waiting >= PACKED:
                yield pa.RecordBatch.from_pylist(list(told(np.concatenate(keys), np.concatenate(links))), _COUNTS)
                keys, links, waiting = [], [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(list(told(np.concatenate(keys), np.concatenate(links))), _COUNTS)

    return run


_COUNTS = pa.schema([("part", pa.int64()), ("step", pa.int32()), ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary())])
_COUNTS_DDL = "part long, step int, n_pairs long, pairs binary, times binary"


def _given(width: int):
    """What each document of a message gets, from a stream sorted by part, task and step."""

    @tidy
    def run(batches):
        own, table, pairs, links, best = None, [], None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["part"], row["task"]) != own:
                    own, table, pairs = (row["part"], row["task"]), [], None
                if row["step"] == 0:
                    table.append((_unpacked(row["pairs"], np.int64, row["n_pairs"]), _unpacked(row["times"], np.int64, row["n_pairs"])))
                    continue
                if pairs is None:
                    pairs, links = (np.concatenate(x) for x in zip(*table, strict=True))
                    order, table = np.argsort(pairs), []
                    pairs, links = pairs[order], links[order]
                    ids = pairs // width
                    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    best = links == np.repeat(np.maximum.reduceat(links, heads), np.diff(np.append(heads, len(ids))))
                found, of, place, times = _entries(row)
                at = np.searchsorted(pairs, found)
                count, high = links[at][of], best[at][of]
                n_best, total = (np.zeros(1 + place.max(), np.int64) for _ in range(2))
                np.add.at(n_best, place, times * high)
                np.add.at(total, place, times * count)
                # a document that has a pair has a sum of counts
                some = np.flatnonzero(total)
                columns = {"lot": [row["lot"]], "n": [len(some)], "places": [_packed(some.astype(np.int32))], "best": [_packed(n_best[some])], "total": [_packed(total[some])]}
                yield pa.RecordBatch.from_pydict(columns, pa.schema([("lot", pa.string()), ("n", pa.int64()), *((c, pa.binary()) for c in ("places", "best", "total"))]))

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@tidy
def _finished(table: pa.Table) -> pa.Table:
    """A lot's documents with what its parts give them."""
    rows = table.to_pylist()
    docs = [d for row in rows for d in row["docs"] or ()]
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for row in rows:
        if row["n"]:
            # a document has one place in a message
            at = _unpacked(row["places"], np.int32, row["n"])
            best[at] += _unpacked(row["best"], np.int64, row["n"])
            total[at] += _unpacked(row["total"], np.int64, row["n"])
    own = pa.array(docs, _DOC)
    columns = {name: own.field(k) for k, name in enumerate(f.name for f in _DOC)}
    columns |= {"n_best": pa.array(best), "count_sum": pa.array(total)}
    return pa.table({f.split()[0]: columns[f.split()[0]] for f in _RESULT.split(", ")})


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tokens, groups and links of every text under both tokenizers, and how its links' pairs count in
    the corpus.

    Takes ``doc_id`` and ``text``; other columns are ignored.  ``path_a``: a tokenizers file with a
    byte-level BPE model, ``path_b``: a piece model with byte fallback, both readable on every
    machine.  Returns a row per input row: ``doc_id, n_a, n_b`` (tokens), ``n_groups, n_links, n_best``
    (links whose count is their B id's highest), ``count_sum`` (of the links' counts) and
    ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``).  A text that is null or empty, or whose tokens of
    either side don't give its bytes, has zeros and ''.  Texts are encoded whole, however long;
    strings of special tokens are plain text; repeated rows are texts of their own and count as such; a null
    doc_id stays null; an empty table gives an empty one.
    """
    width = sides(path_a, path_b).width
    scanned = checkpointed(_scan(docs, path_a, path_b))
    messages = scanned.where("part IS NOT NULL")
    # a number for each part
    entries = {r["part"]: r["n"] for r in messages.groupBy("part").agg(F.sum("n_entries").alias("n")).collect()}
    low, high = TASK_ENTRIES
    each = min(high, max(low, sum(entries.values()) // (8 * PARTS)))
    tasks = docs.sparkSession.createDataFrame([(p, -(-n // each)) for p, n in entries.items()], "part long, tasks int")

    counts = _counted(scanned).mapInArrow(_packed_counts(width), _COUNTS_DDL).join(F.broadcast(tasks), "part")
    nothing = F.lit(None).cast("binary")
    counts = counts.select(
        "part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "step", F.lit(None).cast("string").alias("lot"), "n_pairs",
        F.lit(None).cast("long").alias("n_entries"), "pairs", nothing.alias("per_pair"), nothing.alias("places"), "times",
    )
    dealt = messages.join(F.broadcast(tasks), "part").select(
        "part", F.pmod(F.xxhash64("lot"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("step"), "lot", "n_pairs", "n_entries", "pairs", "per_pair", "places", "times",
    )
    n_tasks = sum(-(-n // each) for n in entries.values())
    stream = counts.unionAll(dealt).repartition(max(1, n_tasks), "part", "task").sortWithinPartitions("part", "task", "step")
    given = stream.mapInArrow(_given(width), "lot string, n long, places binary, best binary, total binary")

    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("places", "binary"), ("best", "binary"), ("total", "binary"))]
    lots = scanned.where("docs IS NOT NULL").select("lot", "docs", *none)
    given = given.select("lot", F.lit(None).cast(f"array<{_DOC_DDL}>").alias("docs"), "n", "places", "best", "total")
    return lots.unionAll(given).groupBy("lot").applyInArrow(lambda table: _finished(table), _RESULT)
