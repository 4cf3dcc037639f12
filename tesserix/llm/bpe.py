"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct new pieces of a partition's texts (what the pre-tokeniser's pattern cuts) lie end to
end in one array of symbols, each linked to its neighbours.  The index maps every pair that a rule
merges, by the rule's rank, to all positions where it stands.  Active ranks come from a heap in
ascending order over all pieces at once: the positions of the lowest rank merge together, and only
the lists of the pairs that their neighbours now form are updated.  Entries that a merge made stale
are passed over when their rank comes up, as a position knows the rank of its pair.

A merge only ever makes pairs of higher rank, which is checked of the rules, so each rank comes up
once.  Runs that were encoded are kept from batch to batch in a bounded table, as most recur.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import tidy
from .words import slices

#: The pre-tokeniser's pattern of byte-level BPE (fixed value of the tokenizer's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters with Unicode's White_Space property (fixed values of the standard).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs that no piece crosses: cutting here first lets whole runs be looked up.
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Runs whose encoding is kept; the table is emptied when it is full.
KEPT_RUNS = 200_000
KEPT_CHARS = 64
#: Bytes of text whose new pieces are indexed together.
TOGETHER = 1 << 21
_NEVER = np.int32(1 << 30)
#: The symbol beyond either end of a piece, which no rule knows.
_END = np.int32((1 << 31) - 1)

_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in vocabularies: itself if printable, else the
    next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Ids, merge ranks and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        symbols = _byte_symbols()
        vocab = file["model"]["vocab"]
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in vocab.items() if all(c in symbols for c in token)}
        self.byte_id = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int32)
        rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            rules.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self._index_rules(rules, len(file["model"]["merges"]))
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self._forget()

    def _index_rules(self, rules: dict, n_ranks: int) -> None:
        """A direct-mapped table from pairs to ranks, and a sorted one for pairs that collide."""
        keys = np.array([a << 32 | b for a, b in rules], np.uint64)
        ranks = np.array([r for r, _ in rules.values()], np.int32)
        self.merged = np.zeros(n_ranks, np.int32)
        self.merged[ranks] = [m for _, m in rules.values()]
        self.twin = np.zeros(n_ranks, bool)
        self.twin[ranks] = [a == b for a, b in rules]
        used = np.full(1 + int(max(map(max, rules), default=0)) + int(self.merged.max(initial=0)), _NEVER)
        for pair, (rank, _) in rules.items():
            for half in pair:
                used[half] = min(used[half], rank)
        if (used[self.merged[ranks]] < ranks).any():
            raise ValueError("a rule of the tokenizer uses a symbol that a later rule makes")
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.slot_key, self.slot_rank = np.full(1 << 20, np.uint64(1 << 63)), np.full(1 << 20, _NEVER)
        slot = self._slot(keys)
        self.slot_key[slot], self.slot_rank[slot] = keys, ranks
        self.crowded = np.bincount(slot, minlength=1 << 20) > 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NEVER where no rule merges it."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_rank[slot], _NEVER)
        again = np.flatnonzero(self.crowded[slot])
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == keys[again], self.ranks[at], _NEVER)
        return out

    def _forget(self) -> None:
        """Empty the table of runs: run i has the ids pool[bounds[i]:bounds[i + 1]]."""
        self.known = _Numbers()
        self.pool, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end and the bounds of each."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        # position n stands for what lies beyond a piece's ends
        symbol = np.append(self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], _END)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        some = sizes > 0
        after[ends[some] - 1] = before[(ends - sizes)[some]] = after[n] = before[n] = n
        rank = np.append(self._ranks_of(symbol[:n], symbol[after[:n]]), _NEVER)
        live = np.ones(n + 1, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._list(index, active, rank, np.flatnonzero(rank != _NEVER))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            if self.twin[r]:
                # of positions side by side, as in "aaa", every other one from the left merges
                heads = np.flatnonzero(np.append(True, right[:-1] != at[1:]))
                place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
                at, right = at[place % 2 == 0], right[place % 2 == 0]
            symbol[at] = self.merged[r]
            live[right], rank[right] = False, _NEVER
            beyond = after[right]
            after[at], before[beyond] = beyond, at
            changed = np.concatenate([before[at], at])
            rank[changed] = self._ranks_of(symbol[changed], symbol[after[changed]])
            self._list(index, active, rank, changed[rank[changed] != _NEVER])
        live[n] = False
        kept = np.append(0, np.cumsum(live[:n]))
        return symbol[live], np.append(0, kept[ends])

    @staticmethod
    def _list(index: dict[int, list[np.ndarray]], active: list[int], rank: np.ndarray, at: np.ndarray) -> None:
        """Enter positions in the lists of their pairs; a pair that had none becomes active."""
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        ranks = rank[at]
        heads = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
        for r, a, b in zip(ranks[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(active, r)

    def _learn(self) -> None:
        """Encode the runs that are numbered but not in the table yet, by way of their distinct pieces."""
        place = _Numbers()
        cut, sizes = [], []
        for run in islice(self.known, len(self.bounds) - 1, None):
            # letters with or without a space before them are one piece
            pieces = [run] if run.isalpha() or (run[0] == " " and run[1:].isalpha()) else self.pieces(run)
            cut += [place[p] for p in pieces]
            sizes.append(len(pieces))
        if not sizes:
            return
        ids, bounds = self.encode_pieces([p.encode() for p in place])
        ids, counts = _gathered(ids, bounds, np.array(cut, np.int64))
        totals = np.add.reduceat(counts, np.append(0, np.cumsum(sizes))[:-1])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(totals))
        self.pool = np.append(self.pool, ids)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; added tokens in it are found first, as in the format's own rules."""
        if len(self.known) > KEPT_RUNS:
            self._forget()
        known, had, out = self.known, len(self.known), []
        for t in texts:
            parts = self.split_added.split(t) if self.split_added and any(a in t for a in self.added) else [t]
            # an added token or the numbers of the runs
            out.append([p if k % 2 else np.array([known[r] for r in _CHUNKS.findall(p)], np.int32) for k, p in enumerate(parts)])
        self._learn()
        for k, parts in enumerate(out):
            ids = [np.array([self.added[p]], np.int32) if isinstance(p, str) else _gathered(self.pool, self.bounds, p)[0] for p in parts]
            out[k] = ids[0] if len(ids) == 1 else np.concatenate(ids)
        if any(len(r) > KEPT_CHARS for r in islice(known, had, None)):
            self._forget()
        return out

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


class _Numbers(dict):
    """Numbers keys from 0 in the order in which they are asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _gathered(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``values`` end to end, and the length of each."""
    first, counts = bounds[which], bounds[which + 1] - bounds[which]
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + counts, counts)
    return values[at], counts


def tokenize(docs: DataFrame, path: str, with_tokens: bool = True) -> DataFrame:
    """Encode every text and decode the ids again.

    Takes ``doc_id`` and ``text``; other columns are ignored.  ``path``: a tokenizers file with a
    byte-level BPE model, readable on every machine.  A null text counts as empty and an empty
    one has no tokens; a null doc_id stays null; repeated rows get the same values each; an empty
    table gives an empty one.  Texts are encoded whole, however long.  Added tokens that stand in
    a text become their ids; nothing is added, cut off or padded.  Returns a row per input row:
    ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``,
    ``ids`` and ``decoded`` (both null unless ``with_tokens``).
    """

    @tidy
    def run(batches):
        tokenizer = Tokenizer(path)
        number = [str(i) for i in range(1 + max(tokenizer.bytes_of))]
        for batch in batches:
            for part in slices(batch, limit=TOGETHER):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n, shas, back, all_ids, all_decoded = [], [], [], [], []
                for ids in map(np.ndarray.tolist, tokenizer.encode_batch(texts)):
                    decoded = tokenizer.decode(ids)
                    n.append(len(ids))
                    shas.append(hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    all_ids.append(ids if with_tokens else None)
                    all_decoded.append(decoded if with_tokens else None)
                columns = [
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string()),
                    pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_decoded, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT)
