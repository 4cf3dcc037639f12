"""N-gram Jaccard join: which texts share at least three quarters of their word shingles.

1.  Every batch of texts reports its distinct shingles; the owners of the hash space answer
    with each one's document frequency.  A text of n shingles can only link to another if
    three quarters of n are shared with somebody, so all others are done with here.
2.  Texts with equal sets become one class.  Classes meet in blocks by min-hash and are linked
    there, which turns a group of near copies into one component at linear cost.
3.  The rest is exact: the rarest token that two linked classes share is among the rarest ones
    of each, the probe prefix of the larger set and the shorter index prefix of the smaller.
    Components that meet so without being joined yet are brought together, the smaller one as
    queries and the larger one as index, and searched.  Tokens that few texts have are routed
    a part of the hash space at a time; common ones by joins, dealt over many tasks.

Blocks are searched by T-occurrence (DivideSkip): a query's short inverted lists are merged with
a heap that skips what can't occur often enough, candidates that do are probed for in its long
lists by binary search, and those that reach the overlap are links.  Candidates of the query's
own component are skipped, so links that join nothing new are never verified.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import batch_count, binary_column, checkpointed, flat_binary, salted_join, text_bytes, tidy, whole_rows
from .components import components
from .words import LOWER, Words, distinct, mix

SHINGLE = 5
PERCENT = 75
#: Classes that one task searches at a time.
BLOCK = 1024
#: Rounds of blocking before the exact search.
ROUNDS = 2
#: Documents from which on a token's components are routed by joins (as counted, to a factor of two).
COMMON = 2048
#: Entries of short lists up to which a heap merges them; more are merged run by run in one sort.
HEAPED = 4096
#: Rows without a doc_id have nodes from here on.
_NO_ID = 1 << 62

_REPORT = "bucket int, batch int, prints binary"
_ANSWER = "batch int, bucket int, levels binary"
_SETS = "node long, missing boolean, text_key long, n_shingles long, digest binary, tokens binary, cool int, keys array<long>"


def shingles(texts, size: int):
    """Distinct shingles of a batch of lower-cased texts: (hashes, text of each, index of
    each in hashes), texts ascending.  Texts with fewer words have their whole sequence."""
    words = Words(texts, fold=LOWER)
    starts, hashes = words.windows(size)
    owner = np.searchsorted(words.bounds, starts, "right") - 1
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = words.window_hashes(words.bounds[short], counts[short])
        owner, hashes = np.append(owner, short), np.append(hashes, whole)
    names, index = np.unique(hashes, return_inverse=True)
    code = distinct(owner * max(1, len(names)) + index)
    return names, code // max(1, len(names)), code % max(1, len(names))


def _level(count: np.ndarray) -> np.ndarray:
    """0 for a frequency of one, else one more than eight times its logarithm."""
    return np.where(count > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)


class _Frequencies:
    """Document frequencies of shingles, by messages between batches and hash buckets."""

    def __init__(self, size: int, percent: int, buckets: int, rounds: int, common: int):
        self.size, self.percent, self.buckets, self.rounds = size, percent, buckets, rounds
        self.cool = _level(np.array([common]))[0]

    def _runs(self, found: np.ndarray):
        of = (found >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        names, first = np.unique(of, return_index=True)
        return names, np.append(first, len(found))

    @tidy
    def report(self, key, texts: pa.Table) -> pa.Table:
        found, _, index = shingles(texts["text"], self.size)
        names, bounds = self._runs(found)
        # 28 bits of each hash besides its bucket, and the logarithm of the texts that have it here
        counts = np.frexp(np.bincount(index, minlength=len(found)))[1] - 1
        prints = found.astype(np.uint32) << np.uint32(4) | np.clip(counts, 0, 15).astype(np.uint32)
        return pa.table(
            {
                "bucket": pa.array(names.astype(np.int32)),
                "batch": pa.array(np.full(len(names), key[0].as_py()), pa.int32()),
                "prints": binary_column(prints, bounds),
            }
        )

    @tidy
    def answer(self, key, reports: pa.Table) -> pa.Table:
        """The level of each token, which all its texts are told alike."""
        prints, bounds = flat_binary(reports["prints"], np.uint32)
        _, index = np.unique(prints >> np.uint32(4), return_inverse=True)
        levels = _level(np.bincount(index, weights=np.exp2(prints & np.uint32(15))))[index]
        some = [i for i in range(len(bounds) - 1) if levels[bounds[i] : bounds[i + 1]].any()]
        return pa.table(
            {
                "batch": reports["batch"].combine_chunks().take(pa.array(some, pa.int64())),
                "bucket": pa.array(np.full(len(some), key[0].as_py()), pa.int32()),
                "levels": pa.array([levels[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary()),
            }
        )

    @tidy
    def sets(self, key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        found, owner, index = shingles(texts["text"], self.size)
        names, bounds = self._runs(found)
        levels = np.zeros(len(found), np.uint8)
        for bucket, got in zip(answers["bucket"].to_pylist(), answers["levels"].to_pylist(), strict=True):
            k = int(np.searchsorted(names, bucket))
            levels[bounds[k] : bounds[k + 1]] = np.frombuffer(got, np.uint8)
        n_texts = texts.num_rows
        n = np.bincount(owner, minlength=n_texts)
        level = levels[index]
        shared = np.bincount(owner[level > 0], minlength=n_texts)
        kept = np.flatnonzero((n > 0) & (100 * shared >= self.percent * n))
        edges = np.searchsorted(owner, np.arange(n_texts + 1))
        # of equal sets the row with the least node bears the tokens
        nodes, bearer = texts["node"].to_pylist(), {}
        digests, tokens, cool, keys = ([None] * n_texts for _ in range(4))
        for i in kept.tolist():
            digest = hashlib.blake2b(found[index[edges[i] : edges[i + 1]]].tobytes(), digest_size=16).digest()
            digests[i] = digest
            if digest not in bearer or nodes[i] < nodes[bearer[digest]]:
                bearer[digest] = i
        for i in bearer.values():
            h, lv = found[index[edges[i] : edges[i + 1]]], level[edges[i] : edges[i + 1]]
            h, lv = h[lv > 0], lv[lv > 0]
            tokens[i] = h[np.argsort(lv, kind="stable")].tobytes()
            cool[i] = int((lv <= self.cool).sum())
            keys[i] = [int(mix(h ^ np.uint64(0x5851F42D4C957F2D * (r + 1) % (1 << 64))).min() >> np.uint64(1)) for r in range(self.rounds)]
        return pa.table(
            {
                "node": texts["node"],
                "missing": texts["missing"],
                "text_key": texts["text_key"],
                "n_shingles": pa.array(n.astype(np.int64)),
                "digest": pa.array(digests, pa.binary()),
                "tokens": pa.array(tokens, pa.binary()),
                "cool": pa.array(cool, pa.int32()),
                "keys": pa.array(keys, pa.list_(pa.int64())),
            }
        )


class Search:
    """T-occurrence search over one block of sets, joining components as links are found.

    ``labels``: each set's component; sets ``n_index`` and after are queries only.  Tokens are
    those shared with other sets, the rarest first; ``sizes`` count the others as well.
    """

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, labels: np.ndarray, n_index: int, percent: int):
        self.tokens, self.bounds, self.sizes, self.percent = tokens, bounds, sizes, percent
        _, self.label = np.unique(labels, return_inverse=True)
        self.members: dict[int, list[int]] = {}
        for i, c in enumerate(self.label.tolist()):
            self.members.setdefault(c, []).append(i)
        self.n_index = n_index
        owner = np.repeat(np.arange(n_index), np.diff(bounds[: n_index + 1]))
        order = np.argsort(tokens[: bounds[n_index]], kind="stable")
        self.names, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(order))
        self.lists = owner[order]
        self.flat = memoryview(self.lists)
        rank = np.repeat(np.arange(len(self.names)), np.diff(self.first))
        self.keys = rank * max(1, n_index) + self.lists
        self.links: list[tuple[int, int]] = []

    def _join(self, x: int, y: int) -> None:
        self.links.append((x, y))
        a, b = int(self.label[x]), int(self.label[y])
        if len(self.members[a]) > len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(a)
        self.label[moved] = b
        self.members[b] += moved

    def query(self, x: int, before: int | None = None) -> None:
        """Join ``x`` with all it links to (those before index ``before``, if given)."""
        own = self.tokens[self.bounds[x] : self.bounds[x + 1]]
        if not len(own) or not len(self.names):
            return
        n = int(self.sizes[x])
        least = -(-self.percent * n // 100)
        at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
        at = at[self.names[at] == own]
        if len(at) < least:
            return
        lengths = self.first[at + 1] - self.first[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        n_long = min(int(least / (0.01 * math.log2(lengths[-1] + 1) + 1)), least - 1)
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        heaped = lengths[: len(short)].sum() <= HEAPED
        found, times = (self._merge_skip if heaped else self._merge_runs)(short, least - n_long)
        m = self.sizes[found]
        keep = (100 * m >= self.percent * n) & (100 * n >= self.percent * m)
        keep &= self.label[found] != self.label[x]
        if before is not None:
            keep &= found < before
        found, times = found[keep], times[keep]
        order = np.argsort(-times, kind="stable")
        found, times, step = found[order], times[order], 4
        while len(found):
            part, count = found[:step], times[:step].copy()
            if len(long):
                probes = long[:, None] * self.n_index + part[None, :]
                spot = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
                count += (self.keys[spot] == probes).sum(axis=0)
            linked = 100 * count >= self.percent * (n + self.sizes[part] - count)
            for y in part[linked].tolist():
                if self.label[y] != self.label[x]:
                    self._join(x, y)
            found, times = found[step:], times[step:]
            rest = self.label[found] != self.label[x]
            found, times, step = found[rest], times[rest], min(256, step * 4)


    def _merge_skip(self, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets in ``least`` of the lists or more, and how many, by a heap of the lists' heads.

        A set below the ``least``-th smallest head is in too few lists, so the lists before that
        one skip ahead to it by binary search.
        """
        lists, found, times = self.flat, [], []
        heap = [(lists[k], k, end) for k, end in zip(self.first[at].tolist(), self.first[at + 1].tolist(), strict=True)]
        heapq.heapify(heap)
        while len(heap) >= least:
            top = heap[0][0]
            popped = [heapq.heappop(heap)]
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                found.append(top)
                times.append(len(popped))
                ahead = [(k + 1, end) for _, k, end in popped]
            else:
                popped += [heapq.heappop(heap) for _ in range(least - 1 - len(popped))]
                ahead = [(bisect_left(lists, heap[0][0], k, end), end) for _, k, end in popped]
            for k, end in ahead:
                if k < end:
                    heapq.heappush(heap, (lists[k], k, end))
        return np.array(found, np.int64), np.array(times, np.int64)

    def _merge_runs(self, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for many entries, which a stable sort merges run by run."""
        merged = np.concatenate([self.lists[self.first[t] : self.first[t + 1]] for t in at.tolist()])
        merged.sort(kind="stable")
        heads = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        times = np.diff(np.append(heads, len(merged)))
        return merged[heads[times >= least]], times[times >= least]


def _pairs(names: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})


@tidy
def _search_block(block: pa.Table, percent: int) -> pa.Table:
    """Links that make components of the classes of one block; a class is named by its least
    node, whose row all blocks with that class hold."""
    block = block.sort_by([("n_shingles", "ascending"), ("node", "ascending")])
    seen: dict[bytes, int] = {}
    for i, digest in enumerate(block["digest"].to_pylist()):
        seen.setdefault(digest, i)
    block = block.take(pa.array(list(seen.values()), pa.int64()))
    tokens, bounds = flat_binary(block["tokens"], np.uint64)
    nodes = block["node"].to_numpy()
    search = Search(tokens, bounds, block["n_shingles"].to_numpy(), np.arange(len(nodes)), len(nodes), percent)
    for x in range(1, len(nodes)):
        search.query(x, before=x)
    return _pairs(nodes, search.links)


@tidy
def _search_between(block: pa.Table, percent: int) -> pa.Table:
    """Links between components: ``query`` rows against the others."""
    block = block.sort_by([("query", "ascending"), ("n_shingles", "ascending"), ("rep", "ascending")])
    tokens, bounds = flat_binary(block["tokens"], np.uint64)
    comps = block["comp"].to_numpy()
    n_index = int((~block["query"].to_numpy(zero_copy_only=False)).sum())
    search = Search(tokens, bounds, block["n_shingles"].to_numpy(), comps, n_index, percent)
    for x in range(n_index, len(comps)):
        search.query(x)
    return _pairs(comps, search.links)


def _probe_length(n, percent: int):
    """Tokens, the rarest first, of which a set shares one with any smaller set that it links to."""
    return n + (-percent * n // 100) + 1


def _prefixes(batches, percent: int):
    """Distinct (token, component) among the probe prefixes; ``index``: it is in the index prefix
    of a set as well, one of which it shares with any larger set that it links to; ``common``:
    many texts have the token."""
    for batch in batches:
        tokens, bounds = flat_binary(batch.column("tokens"), np.uint64)
        n = batch.column("n_shingles").to_numpy()
        shared = np.diff(bounds)
        probe = np.clip(_probe_length(n, percent) - (n - shared), 0, shared)
        index = n + (-2 * percent * n // (100 + percent)) + 1 - (n - shared)
        place = np.arange(len(tokens)) - np.repeat(bounds[:-1], shared)
        inside = place < np.repeat(probe, shared)
        of = lambda x: np.repeat(x, shared)[inside]
        columns = [of(batch.column(c).to_numpy()) for c in ("comp", "n_comp", "home")]
        indexed = (place < np.repeat(index, shared))[inside]
        common = place[inside] >= of(batch.column("cool").to_numpy())
        token = tokens[inside].view(np.int64)
        order = np.lexsort((~indexed, columns[0], token))
        token, indexed, common, columns = token[order], indexed[order], common[order], [c[order] for c in columns]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (columns[0][1:] != columns[0][:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[fresh]) for x in (token, *columns, indexed, common)], _POSTING_NAMES)


_POSTINGS = "token long, comp long, n_comp long, home long, indexed boolean, common boolean"
_POSTING_NAMES = [x.split()[0] for x in _POSTINGS.split(", ")]
_ROUTES = "comp long, n_comp long, big boolean, home long, n_home long, query boolean"
_ROUTE_NAMES = [x.split()[0] for x in _ROUTES.split(", ")]


def _home(n_blocks: int, block: int):
    """The block that a component is searched in: its own if it has over ``block`` classes, else
    that of all smaller ones that hash alike."""
    return F.when(F.col("n_comp") > block, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(n_blocks)))


@tidy
def _routes(postings: pa.Table, block: int, at_a_time: int = 1 << 21) -> pa.Table:
    """Which components are to be searched for in which blocks, and which to be found there.

    Two components meet if they share a token that is in the index prefix of either.  The one
    with fewer classes is the query and the other stands in the index of its block.
    """
    token, comp, size, home, indexed = (postings[c].to_numpy() for c in _POSTING_NAMES[:5])
    order = np.lexsort((~indexed, comp, size, token))
    token, comp = token[order], comp[order]
    fresh = np.append(True, (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])) if len(token) else np.empty(0, bool)
    token, comp, size, home, indexed = token[fresh], comp[fresh], *(x[order][fresh] for x in (size, home, indexed))
    # tokens that one component alone has, or that no index prefix holds, bring nobody together
    _, name, times = np.unique(token, return_inverse=True, return_counts=True)
    useful = (times > 1) & (np.bincount(name, indexed, len(times)) > 0)
    name, comp, size, home, indexed = (x[useful[name]] for x in (name, comp, size, home, indexed))
    if not len(name):
        return pa.table({n: pa.array([], k) for n, k in zip(_ROUTE_NAMES, _ROUTE_KINDS, strict=True)})
    place, big = np.arange(len(name)), size > block
    heads = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(name))))
    # the last of a token's components in each block, and the last in an index prefix
    order = np.lexsort((place, home, big, run))
    split = np.flatnonzero(np.append(True, (run[order][1:] != run[order][:-1]) | (home[order][1:] != home[order][:-1]) | (big[order][1:] != big[order][:-1])))
    last, last_indexed = (np.maximum.reduceat(x[order], split) for x in (place, np.where(indexed, place, -1)))
    blocks = order[split]
    n_blocks = np.bincount(run[blocks], minlength=len(heads))
    first_block = np.append(0, np.cumsum(n_blocks))[:-1]
    visits = np.append(0, np.cumsum(n_blocks[run]))
    queries, k = np.empty((2, 0), np.int64), 0
    while k < len(name):
        upto = max(k + 1, int(np.searchsorted(visits, visits[k] + at_a_time, "right")) - 1)
        rows = np.repeat(np.arange(k, upto), n_blocks[run[k:upto]])
        at = first_block[run[rows]] + np.arange(len(rows)) - (visits[rows] - visits[k])
        go = rows < np.where(indexed[rows], last[at], last_indexed[at])
        pairs = np.concatenate([queries, np.stack([rows[go], blocks[at[go]]])], axis=1)
        order = np.lexsort((home[pairs[1]], big[pairs[1]], comp[pairs[0]]))
        pairs = pairs[:, order]
        a, b, c = comp[pairs[0]], home[pairs[1]], big[pairs[1]]
        queries = pairs[:, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))] if len(a) else pairs
        k = upto
    first_indexed = np.minimum.reduceat(np.where(indexed, place, len(name)), heads)
    found = np.flatnonzero(place > np.where(indexed, heads[run], first_indexed[run]))
    found = found[np.unique(comp[found], return_index=True)[1]]
    who, where = np.append(queries[0], found), np.append(queries[1], found)
    n_home = np.where(big[where], size[where], 0)
    asks = np.arange(len(who)) < queries.shape[1]
    columns = (comp[who], size[who], big[where], home[where], n_home, asks)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(_ROUTE_NAMES, columns, _ROUTE_KINDS, strict=True)})


_ROUTE_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())


def _common_routes(postings: DataFrame, block: int) -> DataFrame:
    """The same by joins, for tokens whose components are too many for one task."""
    one = postings.groupBy("token", "comp", "n_comp", "home").agg(F.max("indexed").alias("indexed"))
    one = one.withColumn("place", F.struct("n_comp", "comp")).withColumn("big", F.col("n_comp") > block)
    one = one.withColumn("n_home", F.when(F.col("big"), F.col("n_comp")).otherwise(0))
    indexed = F.when(F.col("indexed"), F.col("place"))
    # partial sums first: a token's components meet only as their number of blocks
    last = one.groupBy("token", "big", "home", "n_home").agg(F.max("place").alias("last"), F.max(indexed).alias("last_indexed"))
    first = one.groupBy("token").agg(F.min("place").alias("first"), F.min(indexed).alias("first_indexed"))
    either = lambda a, b: F.when(F.col("indexed"), F.col(a)).otherwise(F.col(b))
    asked = salted_join(one.drop("big", "home", "n_home"), last, ["token"], "comp").where(F.col("place") < either("last", "last_indexed"))
    found = salted_join(one, first, ["token"], "comp").where(F.col("place") > either("first", "first_indexed"))
    names = _ROUTE_NAMES[:-1]
    return asked.select(*names, F.lit(True).alias("query")).union(found.select(*names, F.lit(False).alias("query")))


def _linked(docs: DataFrame, seed: int | None, size: int, percent: int, block: int, rounds: int, common: int) -> DataFrame:
    """(node, missing, text_key, n_shingles, digest, component) of each row; ``digest`` is null
    where no link is possible, and ``component`` the least node of the row's component."""
    batches = batch_count(text_bytes(docs))
    steps = _Frequencies(size, percent, max(32, batches // 2), rounds, common)
    # rows that repeat each other whole are told apart by where they stand, so that none fill a batch
    spread = F.xxhash64("doc_id", "text", F.shiftright(F.monotonically_increasing_id(), 12))
    texts = docs.select(
        F.pmod(spread, F.lit(batches)).cast("int").alias("batch"),
        node_of(seed).alias("node"), F.col("doc_id").isNull().alias("missing"), F.xxhash64("text").alias("text_key"), "text",
    ).groupBy("batch")
    levels = (
        texts.applyInArrow(lambda key, table: steps.report(key, table), _REPORT)
        .groupBy("bucket")
        .applyInArrow(lambda key, table: steps.answer(key, table), _ANSWER)
    )
    sets = checkpointed(
        texts.cogroup(levels.groupBy("batch")).applyInArrow(lambda key, a, b: steps.sets(key, a, b), _SETS)
    )
    bearers = sets.where("tokens IS NOT NULL")
    n_blocks = max(1, math.ceil(bearers.count() / (block // 2)))
    links = None
    for r in range(rounds):
        found = _blocked_links(bearers, F.col("keys")[r], n_blocks, block, percent)
        links = found if links is None else links.union(found)
    first = components(links)
    label = bearers.groupBy("digest").agg(F.min("node").alias("rep"))
    label = label.join(first, label["rep"] == first["node"], "left").select("digest", "rep", F.coalesce("component", "rep").alias("comp"))
    label = checkpointed(label.join(label.groupBy("comp").agg(F.count("*").alias("n_comp")), "comp"))
    own = ["digest", F.col("node").alias("rep"), "n_shingles", "tokens", "cool"]
    labelled = checkpointed(bearers.select(*own).join(label, ["digest", "rep"]).drop("digest"))
    last = components(_links_between(labelled, n_blocks, block, percent))
    by_class = label.join(last, F.col("comp") == last["node"], "left").select(
        "digest", F.coalesce("component", "comp").alias("component")
    )
    linked = sets.drop("tokens", "cool", "keys").join(by_class, "digest", "left")
    return linked.withColumn("component", F.coalesce("component", "node"))


def node_of(seed: int | None, doc_id="doc_id", text="text"):
    """A row's node: its doc_id, or one that its text determines if it has none."""
    if seed is None:
        return F.coalesce(doc_id)
    return F.coalesce(doc_id, F.lit(_NO_ID) + F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(_NO_ID)))


def _node_seed(docs: DataFrame) -> int | None:
    """A seed with which no row without a doc_id gets another row's doc_id as its node; None if
    all rows have one."""
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return None
    high = docs.where(F.col("doc_id") >= _NO_ID).select("doc_id").distinct()
    seed = 1
    while not nameless.select(node_of(seed).alias("doc_id")).join(high, "doc_id", "left_semi").isEmpty():
        seed += 1
    return seed


def jaccard_components(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, rounds: int = ROUNDS, common: int = COMMON
) -> DataFrame:
    """Connected components of the texts under word-shingle Jaccard similarity.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Words are runs of anything but
    ASCII white space, with A-Z lower-cased; a set holds the distinct sequences of ``size``
    words, or the whole text's if it has fewer; an empty or null text has an empty set and no
    link.  Two texts link when 100 * common >= ``percent`` * (all of both).  Texts are read whole.

    Returns a row per input row: ``doc_id, n_shingles, component_id`` (the least doc_id that
    links lead to, its own included).  Any 64-bit number is an id.  Rows without a doc_id take
    part, those of one text as one node, and a component of them alone has a null component_id.
    Rows that repeat a doc_id are one node, which has the links of each of them.  An empty table
    gives an empty one.
    """
    seed = _node_seed(docs)
    linked = _linked(docs, seed, size, percent, block, rounds, common)
    doc_id = F.when(~F.col("missing"), F.col("node")).alias("doc_id")
    if seed is None:
        return linked.select(doc_id, "n_shingles", F.col("component").alias("component_id"))
    # a component that is named after a row without an id takes its least id, if it has any
    linked = checkpointed(linked.select("node", "missing", "n_shingles", "component"))
    named = linked.where("missing AND node = component").select("component").distinct()
    least = linked.groupBy("component").agg(F.min(F.when(~F.col("missing"), F.col("node"))).alias("least"))
    least = least.join(named, "component").withColumn("renamed", F.lit(True))
    renamed = salted_join(linked, least, ["component"], "node", "left")
    return renamed.select(doc_id, "n_shingles", F.when(F.col("renamed"), F.col("least")).otherwise(F.col("component")).alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, rounds: int = ROUNDS, common: int = COMMON
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each component stays: that
    with the least doc_id (of rows that repeat it, one of those whose text hashes lowest; rows
    without an id count after 2**62).  Rows with an empty set (null and empty texts) stay, and an
    empty table stays empty."""
    seed = _node_seed(docs)
    linked = _linked(docs, seed, size, percent, block, rounds, common).where("digest IS NOT NULL")
    linked = checkpointed(linked.select("node", "text_key", "component"))
    # only a component's own node needs its texts compared, so large components meet nowhere
    heads = linked.where("node = component")
    least = heads.groupBy("component").agg(F.min("text_key").alias("least"), F.count("*").alias("rows"))
    others = linked.where("node <> component").select("node", "text_key").union(
        heads.join(least, "component").where("text_key <> least").select("node", "text_key")
    )
    gone = others.distinct().withColumn("gone", F.lit(True))
    again = least.where("rows > 1").select(F.col("component").alias("node"), F.col("least").alias("text_key"), F.lit(False).alias("gone"))
    marks = gone.union(again.join(gone.drop("gone"), ["node", "text_key"], "left_anti"))
    doc_id, text = F.col("row.doc_id"), F.col("row.text")
    own = whole_rows(docs).select("row", node_of(seed, doc_id, text).alias("node"), F.xxhash64(text).alias("text_key"))
    marked = own.join(marks, ["node", "text_key"], "left")
    once = marked.where("gone IS NULL").select("row.*")
    repeated = marked.where("NOT gone").dropDuplicates(["node", "text_key"]).select("row.*")
    return once.union(repeated) if not again.isEmpty() else once


def _blocked_links(bearers: DataFrame, key, n_blocks: int, block: int, percent: int) -> DataFrame:
    """Links within blocks of classes with alike min-hash.  A min-hash with many classes is dealt
    over several blocks, small ones as all its sets are alike; the next round deals it differently."""
    alike = max(1, block // 8)
    keyed = bearers.select(key.alias("key"), "node", "digest", "n_shingles", "tokens")
    hot = checkpointed(keyed.groupBy("key").agg(F.count_distinct("digest").alias("n")).where(F.col("n") > alike))
    home = F.pmod(F.col("key"), F.lit(n_blocks))
    dealt = keyed.select(F.lit(-1).alias("part"), home.alias("home"), "node", "digest", "n_shingles", "tokens")
    if not hot.isEmpty():
        part = F.pmod(F.xxhash64("digest", "key"), F.ceil(F.col("n") / alike)).cast("int")
        dealt = keyed.join(hot, "key", "left").select(
            F.coalesce(part, F.lit(-1)).alias("part"),
            F.when(F.col("n").isNull(), home).otherwise(F.col("key")).alias("home"),
            "node", "digest", "n_shingles", "tokens",
        )
    return dealt.groupBy("part", "home").applyInArrow(lambda table: _search_block(table, percent), "a long, b long")


def _links_between(labelled: DataFrame, n_blocks: int, block: int, percent: int) -> DataFrame:
    """Links between components that a prefix token shows to be possible, all verified."""
    labelled = labelled.withColumn("home", _home(n_blocks, block))
    postings = labelled.mapInArrow(lambda it: _prefixes(it, percent), _POSTINGS)
    rare = postings.where("NOT common").groupBy(F.pmod("token", F.lit(16 * n_blocks + 99)).alias("part"))
    routes = rare.applyInArrow(lambda table: _routes(table, block), _ROUTES)
    probe = F.expr(f"n_shingles - CAST(ceil({percent} * n_shingles / 100) AS BIGINT) + 1")
    if not labelled.where(F.col("cool") < probe - F.col("n_shingles") + F.octet_length("tokens") / 8).isEmpty():
        routes = routes.union(_common_routes(postings.where("common"), block))
    routes = checkpointed(routes.distinct())
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block).cast("int"))
    asked = routes.where("query")
    wanted = asked.groupBy("big", "home").agg(F.max("n_home").alias("n_home"), F.sum("n_comp").alias("n_queries"))
    wanted = wanted.select("big", "home", chunks("n_home").alias("chunks"), chunks("n_queries").alias("parts"))
    # a query goes to all chunks of a block's index, a row of the index to all parts of its queries
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one_of = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    both = (
        labelled.drop("n_comp", "home", "cool")
        .join(routes.select("comp", "big", "home", "query").join(wanted, ["big", "home"]), "comp")
        .withColumn("chunk", F.explode(F.when(F.col("query"), all_of("chunks")).otherwise(one_of("chunks"))))
        .withColumn("part", F.explode(F.when(F.col("query"), one_of("parts")).otherwise(all_of("parts"))))
        .drop("chunks", "parts")
    )
    return both.groupBy("big", "home", "chunk", "part").applyInArrow(
        lambda table: _search_between(table, percent), "a long, b long"
    )
