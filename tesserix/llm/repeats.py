"""Substring dedup: passages of many words that stand in the corpus more than once.

Fixed-block anchors.  Every text is an index of non-overlapping reference blocks (words 0-17,
18-35, ... for windows of 35 words) and at the same time a probe with every rolling window of a
block's length.  A window of 35 words covers a whole reference block wherever it stands, so each
repeat is hit by at least one probe.  Hits are extended: the full windows around them are
compared by 127 bits of two hashes, few enough windows in any corpus for no two to agree by
chance, and the runs of confirmed windows are the maximal exact repeats.

Neither step pairs occurrences, so a passage in a third of all texts costs as much as any
other: a batch of texts reports each distinct hash once, with a flag for "more than once here",
to the owner of that part of the hash space, and is told which of its entries are hot.
Messages are packed arrays; texts are shuffled once, and later passes reuse that exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import batch_count, binary_column, flat_binary, text_bytes, tidy
from .words import Words

WINDOW = 35
#: Base of the windows' second hash.
_SECOND_BASE = 0xA24BAED4963EE407

_MESSAGE = "bucket int, batch int, phase int, entries binary"
_ANSWER = "batch int, phase int, bucket int, hot binary"
_RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "repeats array<struct<first_word:long,n_words:long>>, kept string"
)


def _anchor_keys(words: Words, block: int, buckets: int):
    """Rolling windows of a block's length: starts, distinct keys (bucket above a 30-bit
    fingerprint), each window's key and whether it is a reference block."""
    starts, hashes = words.windows(block)
    keys = ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(30)) | (hashes & np.uint64((1 << 30) - 1))
    distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    first = words.bounds[np.searchsorted(words.bounds, starts, "right") - 1]
    return starts, distinct, inverse, counts, (starts - first) % block == 0


def _by_bucket(buckets_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and the bounds of their runs."""
    names, first = np.unique(buckets_of, return_index=True)
    return names, np.append(first, len(buckets_of))


def _ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by both, and whether each entry differs from the one before it."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]


def _hot_entries(answers: pa.Table, phase: int, names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A flag for each distinct key, from the answers of the buckets."""
    hot = np.zeros(bounds[-1], bool)
    mine = answers.filter(pc.equal(answers["phase"], phase))
    for bucket, bits in zip(mine["bucket"].to_pylist(), mine["hot"].to_pylist(), strict=True):
        k = int(np.searchsorted(names, bucket))
        n = bounds[k + 1] - bounds[k]
        hot[bounds[k] : bounds[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return hot


class _Passes:
    """The functions that tasks run; all of them derive the same keys from the same batch."""

    def __init__(self, window: int, buckets: int, with_text: bool):
        self.window, self.buckets, self.with_text = window, buckets, with_text
        self.block = (window + 1) // 2

    @tidy
    def probe(self, key, table: pa.Table) -> pa.Table:
        words = Words(table["text"])
        _, distinct, inverse, counts, reference = _anchor_keys(words, self.block, self.buckets)
        indexed = np.zeros(len(distinct), bool)
        indexed[inverse[reference]] = True
        entries = ((distinct & np.uint64((1 << 30) - 1)) << np.uint64(2)) | (indexed.astype(np.uint64) << np.uint64(1))
        entries |= (counts > 1).astype(np.uint64)
        return self._message(key, 1, distinct >> np.uint64(30), entries.astype(np.uint32))

    @tidy
    def match(self, key, table: pa.Table) -> pa.Table:
        """Which entries of a bucket stand for a reference block that another place repeats."""
        phase = table["phase"].to_numpy()
        return pa.concat_tables(
            self._matched(key, table.filter(pa.array(phase == p)), p) for p in (1, 2) if (phase == p).any()
        )

    def _matched(self, key, table: pa.Table, phase: int) -> pa.Table:
        entries, bounds = flat_binary(table["entries"], np.uint32 if phase == 1 else np.uint64)
        if phase == 1:
            value = entries >> np.uint32(2)
            order = np.argsort(value, kind="stable")
            fresh = np.append(True, value[order][1:] != value[order][:-1])[: len(value)]
        else:
            (entries, second), bounds = entries.reshape(-1, 2).T, bounds // 2
            order, fresh = _ordered(entries >> np.uint64(1), second)
        group = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        often = np.diff(np.append(heads, len(order))) > 1
        often |= np.logical_or.reduceat((entries[order] & 1) > 0, heads) if len(heads) else often
        if phase == 1 and len(heads):
            often &= np.logical_or.reduceat((entries[order] & 2) > 0, heads)
        hot = np.empty(len(entries), bool)
        hot[order] = often[group] if len(heads) else False
        found = [i for i in range(len(bounds) - 1) if hot[bounds[i] : bounds[i + 1]].any()]
        batches = table["batch"].to_numpy()
        return pa.table(
            {
                "batch": pa.array(batches[found], pa.int32()),
                "phase": pa.array(np.full(len(found), phase), pa.int32()),
                "bucket": pa.array(np.full(len(found), key[0].as_py()), pa.int32()),
                "hot": pa.array([np.packbits(hot[bounds[i] : bounds[i + 1]]).tobytes() for i in found], pa.binary()),
            }
        )

    def _candidates(self, words: Words, answers: pa.Table):
        """Full windows with a hit inside: starts, distinct keys (two hashes each), each window's key
        and how many windows have each."""
        starts, distinct, inverse, _, _ = _anchor_keys(words, self.block, self.buckets)
        names, bounds = _by_bucket(distinct >> np.uint64(30))
        hits = np.zeros(len(words) + 1, np.int64)
        if len(starts):
            hits[1:][starts] = _hot_entries(answers, 1, names, bounds)[inverse]
        hits = np.cumsum(hits)
        full, _ = Words.windows(words, self.window) if len(words) else (starts, None)
        full = full[hits[full + self.window - self.block + 1] > hits[full]]
        first, second = words.window_hashes(full, self.window) >> np.uint64(1), words.window_hashes(full, self.window, _SECOND_BASE)
        order, fresh = _ordered(first, second)
        inverse = np.empty(len(full), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        keys = np.stack([first[order][fresh], second[order][fresh]], axis=1)
        return full, keys, inverse, np.bincount(inverse, minlength=len(keys))

    def _full_bucket(self, keys: np.ndarray) -> np.ndarray:
        """Follows the keys' order, so that equal buckets stand together."""
        return (keys >> np.uint64(31)) * np.uint64(self.buckets) >> np.uint64(32)

    @tidy
    def extend(self, key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(docs["text"])
        _, keys, _, counts = self._candidates(words, answers)
        entries = np.stack([(keys[:, 0] << np.uint64(1)) | (counts > 1).astype(np.uint64), keys[:, 1]], axis=1)
        return self._message(key, 2, self._full_bucket(keys[:, 0]), entries)

    def _message(self, key, phase: int, buckets_of: np.ndarray, entries: np.ndarray) -> pa.Table:
        names, bounds = _by_bucket(buckets_of) if len(entries) else (np.empty(0, np.uint64), np.zeros(1, np.int64))
        return pa.table(
            {
                "bucket": pa.array(names.astype(np.int32)),
                "batch": pa.array(np.full(len(names), key[0].as_py()), pa.int32()),
                "phase": pa.array(np.full(len(names), phase), pa.int32()),
                "entries": binary_column(entries.ravel(), bounds * (entries.size // max(1, len(entries)))),
            }
        )

    @tidy
    def remove(self, key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(docs["text"])
        full, keys, inverse, _ = self._candidates(words, answers)
        names, bounds = _by_bucket(self._full_bucket(keys[:, 0])) if len(keys) else (keys, np.zeros(1, np.int64))
        repeated = full[_hot_entries(answers, 2, names, bounds)[inverse]] if len(keys) else full
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + self.window, -1)
        gone = np.cumsum(change)[:-1] > 0
        runs = np.zeros(len(words) + 1, bool)
        if len(repeated):
            runs[repeated[np.append(True, np.diff(repeated) > 1)]] = True
        counts, removed = words.counts(), np.add.reduceat(np.append(gone, False), words.bounds[:-1]) * (words.counts() > 0)
        data = memoryview(words.raw)
        digests, kept_texts, spans = [], [], []
        for i in range(docs.num_rows):
            a, b = words.bounds[i], words.bounds[i + 1]
            left = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([data[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)])
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept if self.with_text else None)
            spans.append(self._maximal(repeated, a, b) if removed[i] else [])
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(counts.astype(np.int64)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "kept_sha256": pa.array(digests, pa.string()),
                "repeats": pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))),
                "kept": pa.array(kept_texts, pa.binary()).cast(pa.string()),
            }
        )

    def _maximal(self, repeated: np.ndarray, a: int, b: int) -> list[dict]:
        own = repeated[np.searchsorted(repeated, a) : np.searchsorted(repeated, b)]
        cuts = np.flatnonzero(np.diff(own) > 1)
        heads, tails = own[np.append(0, cuts + 1)], own[np.append(cuts, len(own) - 1)]
        return [{"first_word": int(h - a), "n_words": int(t - h + self.window)} for h, t in zip(heads, tails, strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Drop the words of every passage of ``window`` or more words that also stands elsewhere.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Words are runs of anything but
    ASCII white space.  A word goes if some window of ``window`` words over it has the same
    words as a window that starts at another place of the corpus, the same text included;
    windows are those of the input, so all copies of a passage go.

    Returns a row per input row: ``doc_id, n_words, n_removed, kept_sha256, repeats`` (the
    maximal repeated runs) and ``kept`` (the remaining words joined by a space; null unless
    ``with_text``).  Texts are read whole.  A null text has no words; a null doc_id stays null;
    repeated rows are each other's copies; an empty table gives an empty one.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    batches = batch_count(text_bytes(docs))
    passes = _Passes(window, max(32, batches // 2), with_text)
    # rows that repeat each other whole are told apart by where they stand, so that none fill a batch
    spread = F.xxhash64("doc_id", "text", F.shiftright(F.monotonically_increasing_id(), 12))
    texts = docs.select(F.pmod(spread, F.lit(batches)).cast("int").alias("batch"), "doc_id", "text")
    in_batches = texts.groupBy("batch")
    probes = in_batches.applyInArrow(lambda key, table: passes.probe(key, table), _MESSAGE)
    anchors = probes.groupBy("bucket").applyInArrow(lambda key, table: passes.match(key, table), _ANSWER)
    around = in_batches.cogroup(anchors.groupBy("batch")).applyInArrow(
        lambda key, texts, answers: passes.extend(key, texts, answers), _MESSAGE
    )
    full = around.groupBy("bucket").applyInArrow(lambda key, table: passes.match(key, table), _ANSWER)
    return in_batches.cogroup(anchors.union(full).groupBy("batch")).applyInArrow(
        lambda key, texts, answers: passes.remove(key, texts, answers), _RESULT
    )
