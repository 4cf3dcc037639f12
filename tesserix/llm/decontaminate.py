"""Benchmark decontamination: passages of a benchmark in texts, edits allowed.

CGK embedding: a walk over a word sequence that at every step either stays or moves on by one
word, as a random function of the step and the word says.  Two sequences a few edits apart fall
back into step after each edit, so their walks show the same word at most steps: a small edit
distance becomes a small Hamming distance.  Walks drift apart with the number of edits, so long
items are walked in parts of 15 to 29 words: of a passage within the allowed edits one part at
least has no more than its own share of them.  Every rolling window of a part's size is embedded
and hashed by the words at a few sampled steps; as many repetitions are drawn as the target
recall needs at the most edits, measured on random sequences of the same length.  Where a window
meets a part in any repetition, the whole item is verified by exact edit distance.

All windows of a batch walk together in NumPy arrays.  Whether a word moves a step on is a bit of
its hash times the step's own factor, so no table grows with the vocabulary.  An edit spoils two
pairs of neighbouring words at most, so windows with too few of the benchmark's pairs to come
within the allowed edits of any length in their class are left out before walking, and a window
stops as soon as no item has its sampled word; neither can lose a match that the sampled steps
would make.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .cluster import filter_rows, tidy
from .words import NOT_ALNUM, SAME, Words, mix, slices

#: Edits allowed, as a share of an item's words.
EDITS = 0.2
#: Wanted chance to meet an item at the most edits that are allowed.
RECALL = 0.99
#: Words sampled in a repetition.
SAMPLED = 4
#: Words that the parts of an item have at least, if it has as many; less than twice as many at most.
PART_WORDS = 15
#: Items with fewer words say too little once edited; they are looked for word for word.
LEAST_WORDS = 8
#: Bytes of items that are looked for in one pass over the texts; more items take more passes.
#: A pass's tables take some forty times as much; a longer item is a pass by itself.
PASS_BYTES = 4 << 20

#: Sampled steps whose words are looked up before the walk goes on.
FILTERED = 2
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_FOUND = "doc_id long, item_id long, n_edits int, n_item_words int, first_word long, n_words int"


def _words(texts) -> Words:
    return Words(pc.utf8_lower(texts), separators=NOT_ALNUM, fold=SAME)


def _short(hashes: np.ndarray) -> np.ndarray:
    """What walks tell words by; 0 stands for none."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _pair_hash(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next."""
    return mix(hashes[:-1] * _SPREAD + hashes[1:])


def _window_hash(windows: np.ndarray) -> np.ndarray:
    """A hash of the words in each row."""
    out = np.zeros(len(windows), np.uint64)
    for column in windows.T:
        out = mix(out * _SPREAD + column)
    return out


@functools.cache
def repetitions(n: int, edits: int, recall: float, sampled: int, steps: int, trials: int = 400, rounds: int = 3, most: int = 2000) -> int:
    """Repetitions that meet a share ``recall`` of sequences of ``n`` words after ``edits`` edits.

    Measured on random sequences whose words are deleted, inserted or replaced, at every start
    within the edits, with ``sampled`` of the first ``steps`` steps; of the three kinds of edits
    and of all ``rounds`` the one that needs most counts.
    """
    rng = np.random.default_rng(n)
    starts, size, needed = np.arange(2 * edits + 1), 2 * n + steps + 4 * edits, 4
    for kind in ("delete", "insert", "replace") * rounds:
        labels = rng.integers(0, 4096, (trials, 2 * size))
        items = np.where(np.arange(size) < n, labels[:, :size], 4096)
        texts = labels[:, size:].copy()
        for t in range(trials):
            at = np.sort(rng.choice(n, edits, replace=False))
            own = labels[t, :n].copy()
            if kind == "delete":
                own = np.delete(own, at)
            elif kind == "insert":
                own = np.insert(own, at, rng.integers(0, 4096, edits))
            else:
                own[at] = rng.integers(0, 4096, edits)
            texts[t, edits : edits + len(own)] = own
        left, drawn = np.arange(trials), 0
        while len(left) > (1 - recall) * trials:
            if drawn == most:
                raise ValueError(f"{edits} edits in {n} words: recall {recall} is out of reach")
            drawn += 1
            places = np.sort(rng.choice(steps, min(sampled, steps), replace=False)).tolist()
            bits = rng.integers(0, 2, (places[-1] + 1, 4097))
            a, b = np.zeros(len(left), np.int64), np.tile(starts, (len(left), 1))
            same = np.ones(b.shape, bool)
            for j in range(places[-1] + 1):
                x, y = items[left, a], texts[left[:, None], b]
                if j in places:
                    same &= x[:, None] == y
                a, b = a + bits[j, x], b + bits[j, y]
            left = left[~same.any(axis=1)]
        needed = max(needed, drawn)
    return needed


class Benchmark:
    """The items' words and their hash tables; what every task needs of a benchmark."""

    def __init__(self, ids: list[int], texts: list[str | None], edits=EDITS, recall=RECALL, sampled=SAMPLED, least_words=LEAST_WORDS, seed=7):
        words = _words(pa.array(texts, pa.string()))
        rng = np.random.default_rng(seed)
        self.edits = edits
        self.items: list[tuple[int, np.ndarray]] = []
        short: list[tuple[int, np.ndarray]] = []
        at: dict[int, list[int]] = {}
        for i, item in enumerate(ids):
            own = words.hash[words.bounds[i] : words.bounds[i + 1]]
            if item is not None and len(own) >= least_words:
                self.items.append((item, own))
            elif item is not None and len(own):
                at.setdefault(len(own), []).append(len(short))
                short.append((item, own))
        pairs = [_pair_hash(w) for _, w in self.items]
        self.pairs = np.zeros(1 << max(16, (16 * sum(map(len, pairs))).bit_length()), bool)
        for own in pairs:
            self.pairs[(own & np.uint64(len(self.pairs) - 1)).astype(np.int64)] = True
        # (item, first word, words) of each part
        self.parts = [(m, int(a), int(b - a)) for m, (_, w) in enumerate(self.items) for a, b in self._cuts(len(w))]
        lengths = np.array([n for _, _, n in self.parts], np.int64)
        ranges = list(self._ranges(lengths))
        reps = [self._repetitions(low, lengths, high, recall, sampled) for low, high in ranges]
        self.steps = self._steps(int(lengths.max())) + sampled + 1 if len(lengths) else 0
        # odd factors of each repetition's steps
        self.factors = rng.integers(0, 1 << 31, (max(reps, default=0), self.steps), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.classes = []
        for (low, high), drawn in zip(ranges, reps, strict=True):
            members = np.flatnonzero((lengths >= low) & (lengths <= high))
            shown = np.zeros((len(members), self.steps + high), np.uint32)
            for k, m in enumerate(members.tolist()):
                item, a, n = self.parts[m]
                shown[k, :n] = _short(self.items[item][1][a : a + n])
            least = min(max(0, n - 1 - 2 * self.allowed(n)) for n in lengths[members].tolist())
            self.classes.append((low, high, least, [self._table(r, low, members, shown, sampled, rng) for r in range(drawn)]))
        # short items by length, in the order of their window hashes
        self.short = []
        for n, members in at.items():
            keys = np.array([_window_hash(short[m][1][None, :])[0] for m in members], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.short.append((n, keys[order], np.array(members)[order] + len(self.items)))
        self.items += short

    @staticmethod
    def _cuts(n: int):
        """Bounds of an item's parts, of about equal length."""
        at = np.linspace(0, n, max(1, n // PART_WORDS) + 1).astype(int)
        return zip(at[:-1], at[1:], strict=True)

    @staticmethod
    def _steps(n: int) -> int:
        """Steps that are sampled from in walks over n words."""
        return int(1.6 * n)

    def _repetitions(self, low: int, lengths: np.ndarray, high: int, recall: float, sampled: int) -> int:
        present = np.unique(lengths[(lengths >= low) & (lengths <= high)]).tolist()
        return max(repetitions(n, self.allowed(n), recall, min(sampled, low), self._steps(low)) for n in present)

    @staticmethod
    def _ranges(lengths: np.ndarray):
        low = None
        for n in np.unique(lengths).tolist():
            if low is None or n > 1.25 * low:
                if low is not None:
                    yield low, high
                low = n
            high = n
        if low is not None:
            yield low, high

    def _table(self, rep: int, low: int, members: np.ndarray, shown: np.ndarray, sampled: int, rng):
        """Sampled steps, filters of the words that parts show at the first ones, and the parts by
        hash.  ``shown``: the parts' words, a row each, nothing beyond their ends."""
        steps = np.sort(rng.choice(self._steps(low), min(sampled, low), replace=False))
        size = 1 << max(8, (8 * len(members)).bit_length())
        filters, rows = [], np.arange(len(members))
        at, key = np.zeros(len(members), np.int64), np.zeros(len(members), np.uint64)
        for j in range(steps[-1] + 1):
            word = shown[rows, at]
            if j in steps:
                key = key * _SPREAD + word
                if len(filters) < FILTERED:
                    filters.append(np.zeros(size, bool))
                    filters[-1][word & np.uint32(size - 1)] = True
            at = at + (word * self.factors[rep, j] >> np.uint32(31))
        order = np.argsort(key, kind="stable")
        return steps, filters, key[order], members[order].astype(np.int32)

    def allowed(self, n: int) -> int:
        return int(self.edits * n)

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, part) of the windows that share a hash with a part of an item."""
        n = len(hashes)
        known = np.zeros(n + 1, np.int64)
        np.cumsum(self.pairs[(_pair_hash(hashes) & np.uint64(len(self.pairs) - 1)).astype(np.int64)], out=known[1:n])
        known[n] = known[n - 1]
        padded = np.append(_short(hashes), np.zeros(self.steps + 1, np.uint32))
        starts, parts = [], []
        for _, high, least, tables in self.classes:
            reach = np.minimum(np.arange(high, n + high) + self.allowed(high) - 1, n)
            begin = np.flatnonzero(known[reach] - known[:-1] >= least)
            if not len(begin):
                continue
            for rep, (steps, filters, keys, members) in enumerate(tables):
                at, origin, key, k = begin.copy(), begin, np.zeros(len(begin), np.uint64), 0
                for j in range(steps[-1] + 1):
                    word = padded[at]
                    if j == steps[k]:
                        if k < len(filters):
                            on = filters[k][word & np.uint32(len(filters[k]) - 1)]
                            at, origin, key, word = at[on], origin[on], key[on], word[on]
                        key = key * _SPREAD + word
                        k += 1
                        if not len(at):
                            break
                    at = at + (word * self.factors[rep, j] >> np.uint32(31))
                if len(at):
                    first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    met = np.flatnonzero(last > first)
                    for s, a, b in zip(origin[met].tolist(), first[met].tolist(), last[met].tolist(), strict=True):
                        starts += [s] * (b - a)
                        parts += members[a:b].tolist()
        return np.array(starts, np.int64), np.array(parts, np.int64)

    def matches(self, words: Words):
        """(text, item, edits, first word in its text, words) of the verified passages."""
        if not self.items or not len(words):
            return
        yield from self._copies(words)
        starts, parts = self.candidates(words.hash)
        if not len(starts):
            return
        owner = np.searchsorted(words.bounds, starts, "right") - 1
        items, ahead = np.array(self.parts, np.int64)[parts, :2].T
        starts = starts - ahead  # where the item starts, give or take the edits
        order = np.lexsort((starts, items, owner))
        region = None
        for text, item, start in zip(owner[order].tolist(), items[order].tolist(), starts[order].tolist(), strict=True):
            n = len(self.items[item][1])
            if region and region[:2] == (text, item) and start - region[3] <= n:
                region = (*region[:3], start)
                continue
            if region:
                yield from self._verified(words, *region)
            region = (text, item, start, start)
        yield from self._verified(words, *region)

    def _copies(self, words: Words):
        """The short items' passages, word for word; of overlapping ones the first."""
        owners = words.owner() if self.short else None
        for n, keys, members in self.short:
            starts = np.arange(max(0, len(words) - n + 1))
            starts = starts[owners[starts] == owners[starts + n - 1]]
            found = _window_hash(np.lib.stride_tricks.sliding_window_view(words.hash, n)[starts]) if len(starts) else keys[:0]
            first, last = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            before: dict[tuple[int, int], int] = {}
            for k in np.flatnonzero(last > first).tolist():
                start, text = int(starts[k]), int(owners[starts[k]])
                for m in members[first[k] : last[k]].tolist():
                    apart = start - before.get((text, m), start - n - 1) > n
                    before[text, m] = start
                    if apart and (words.hash[start : start + n] == self.items[m][1]).all():
                        yield text, m, 0, start - int(words.bounds[text]), n

    def _verified(self, words: Words, text: int, item: int, first: int, last: int):
        pattern = self.items[item][1]
        n, d = len(pattern), self.allowed(len(pattern))
        a = max(int(words.bounds[text]), first - 2 * d)
        b = min(int(words.bounds[text + 1]), last + n + 2 * d)
        found = best_substring(pattern, words.hash[a:b])
        if found[0] <= d:
            yield text, item, found[0], a + found[1] - int(words.bounds[text]), found[2] - found[1]


def _ends(pattern: np.ndarray, text: np.ndarray, anchored: bool) -> np.ndarray:
    """Edit distances of the pattern to the text's substrings, the best for each end; of its
    prefixes only, if anchored."""
    steps = np.arange(len(text) + 1)
    row = steps.copy() if anchored else np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_substring(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the substring nearest to the pattern; the first, if several."""
    ends = _ends(pattern, text, anchored=False)
    end = int(ends.argmin())
    back = _ends(pattern[::-1], text[:end][::-1], anchored=True)
    return int(ends[end]), end - int(back.argmin()), end


def _benchmarks(benchmark: DataFrame, **options):
    """The benchmark in groups of a bounded size, in the order of their ids."""
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    group, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row[1].encode())
        if group and size + n > PASS_BYTES:
            yield Benchmark([r[0] for r in group], [r[1] for r in group], **options)
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield Benchmark([r[0] for r in group], [r[1] for r in group], **options)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Passages of the benchmark's items in the texts.

    Words are runs of letters, digits and non-ASCII characters, compared in lower case.  A
    passage matches an item of n words if at most ``edits`` * n words are inserted, deleted
    or replaced.  Items with fewer than ``least_words`` words match only word for word, items
    without words, or with a null text or id, nothing; null and empty texts have no passages; repeated
    rows are found each; texts and items are read whole, however long; without items or texts
    there are no rows.

    Returns ``doc_id, item_id, n_edits, n_item_words, first_word, n_words``: the nearest
    passage to the item in each run of overlapping candidates.
    """
    found = None
    for items in _benchmarks(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        @tidy
        def scan(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for part in slices(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = [
                        (ids[t], items.items[m][0], edits, len(items.items[m][1]), first, n)
                        for t, m, edits, first, n in items.matches(_words(part.column("text")))
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES
                    )

        part = docs.select("doc_id", "text").mapInArrow(scan, _FOUND)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], _FOUND) if found is None else found


_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_KINDS = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in _FOUND.split(", ")]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no passage of the
    benchmark (see :func:`find_leaks`).  Null and empty texts stay; repeated rows stay or go alike."""
    for items in _benchmarks(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(texts, shared=shared):
            keep = np.ones(len(texts), bool)
            keep[[m[0] for m in shared.value.matches(_words(texts))]] = False
            return keep

        docs = filter_rows(docs, clean)
    return docs
