"""Exact top-k search by inner product: columnar branch and bound.

Candidates lie in vertical layout, a row for each dimension, those of most mass first.  Scores
are accumulated block by block of dimensions for many queries at once.  After each block the
Cauchy-Schwarz bound of the remaining dimensions' mass tells which candidates can still reach a
query's k-th best score so far; the others are compacted away, and once few pairs survive each
is finished by itself.

Queries and candidates are packed into blocks by their ids once.  A task's group is a block of
queries and a lane of candidate blocks, which it searches one after another; the k-th best scores
are carried from block to block, so later blocks are cut down sooner.  Lanes and blocks have
bounded sizes, so neither side is ever held whole anywhere, and a block of candidates travels
once for every 16,384 queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import flat_binary, tidy

QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 8192
#: Candidate blocks that one task searches at most, and bytes that a block has at most on average.
LANE, BLOCK_BYTES = 64, 4 << 20
#: Dimensions that are accumulated between two looks at the bounds.
DIMENSIONS = 16
#: Queries that are scored together.
TOGETHER = 128


def quantised(batch: pa.RecordBatch, scale: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * component) of the vectors that take part."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    size = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((size == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    values = vectors.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    finite = np.isfinite(values).all(axis=1)  # nulls are NaN here
    kept = good[finite]
    return ids.take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64), np.floor(scale * values[finite])


def _packed(batches, scale: float, n_queries: int, n_candidates: int, every: int):
    """The vectors by length and block: as candidates and, if their ids ask for it, as queries."""
    for batch in batches:
        sizes = np.unique(pc.list_value_length(batch.column("embedding")).fill_null(0).to_numpy(zero_copy_only=False))
        for dim in sizes[sizes > 0].tolist():
            ids, values = _distinct(*quantised(batch, scale, dim))
            if not len(ids):
                continue
            # small whole numbers fit floats exactly
            values = values.astype(np.float32) if np.abs(values).max(initial=0) < 1 << 24 else values
            rows, mixed = [], _spread(ids)
            for query, n in ((False, n_candidates), (True, n_queries)):
                of = np.where(ids % every == 0, mixed % n, -1) if query else mixed % n
                order = np.argsort(of, kind="stable")
                blocks, first = np.unique(of[order], return_index=True)
                for block, mine in zip(blocks.tolist(), np.split(order, first[1:]), strict=True):
                    if block >= 0 and len(mine):
                        rows.append((dim, block, query, values.itemsize, ids[mine].tobytes(), values[mine].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], _PACKED_NAMES)


_PACKED = "dim int, block int, query boolean, width int, ids binary, values binary"
_PACKED_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _spread(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(8)).astype(np.int64)


def _distinct(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and vectors; of rows that repeat an id the least vector."""
    order = np.argsort(ids, kind="stable")
    if len(ids) and (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((*values.T[::-1], ids))
    ids, values = ids[order], values[order]
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.empty(0, bool)
    return ids[first], values[first]


def _vectors(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and vectors of the packed rows."""
    ids, _ = flat_binary(rows["ids"], np.int64)
    parts = [np.frombuffer(v, f"f{n}").reshape(-1, dim) for v, n in zip(rows["values"].to_pylist(), rows["width"].to_pylist(), strict=True)]
    return _distinct(ids, np.concatenate(parts).astype(float) if parts else np.empty((0, dim)))


@tidy
def _search_lane(table: pa.Table, k: int) -> pa.Table:
    """The best of a lane's candidates for a block of queries."""
    dim, block = table["dim"][0].as_py(), table["block"].to_numpy()
    asked = table["query"].to_numpy(zero_copy_only=False)
    query_ids, queries = _vectors(table.filter(pa.array(asked)), dim)
    best, least = [np.empty(0, np.int64)] * 3, np.full(len(query_ids), -np.inf)
    for b in np.unique(block[~asked]).tolist() if len(query_ids) else []:
        ids, candidates = _vectors(table.filter(pa.array(~asked & (block == b))), dim)
        got = search(query_ids, queries, ids, candidates, k, least=least)
        if not len(got[0]):
            continue
        query, candidate, score = (np.concatenate(x) for x in zip(best, got, strict=True))
        best = _best(query_ids, np.searchsorted(query_ids, query), candidate, score, k)
        # scores come best first for each query, so those with k of them end at the k-th
        full, n = np.unique(best[0], return_counts=True)
        last = np.cumsum(n) - 1
        least[np.searchsorted(query_ids, full[n == k])] = _below(best[2][last[n == k]])
    return pa.table([pa.array(x, pa.int64()) for x in best], names=["query_id", "vec_id", "score"])


def search(query_ids, queries, ids, vectors, k: int, exclude_same: bool = True, least=None):
    """(query, candidate, score) of each query's k best among the candidates, unordered; equal
    scores go to smaller ids.  ``ids`` ascend.  ``least``: scores of each query below which no
    candidate is asked for."""
    least = np.full(len(query_ids), -np.inf) if least is None else least
    dim = vectors.shape[1]
    mass = (vectors**2).sum(axis=0) * (queries**2).sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    # whole numbers whose products and sums a type holds exactly
    most = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * dim
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    layout = np.ascontiguousarray(vectors.T[order].astype(kind))
    asked = queries[:, order].astype(kind)
    cuts = [*range(DIMENSIONS, dim, DIMENSIONS), dim]
    rest_c = {c: np.sqrt((vectors.T[order][c:] ** 2).sum(axis=0)) for c in cuts}
    out = []
    for a in range(0, len(asked), TOGETHER):
        some = slice(a, a + TOGETHER)
        out += _search_some(query_ids[some], asked[some], ids, layout, cuts, rest_c, k, exclude_same, least[some].copy())
    parts = list(zip(*out, strict=True)) if out else [[np.empty(0, np.int64)]] * 3
    return tuple(np.concatenate(p) for p in parts)


def _search_some(query_ids, asked, ids, layout, cuts, rest_c, k, exclude_same, least):
    n, done = len(ids), 0
    live = np.arange(n)
    partial = np.zeros((len(asked), n), layout.dtype)
    own = query_ids[:, None] == ids[None, :] if exclude_same else np.zeros((len(asked), n), bool)
    for cut in cuts:
        block = layout[done:cut] if len(live) == n else layout[done:cut, live]
        partial += asked[:, done:cut] @ block
        done = cut
        if cut == layout.shape[0] or len(live) <= k:
            continue
        if cut == cuts[0] and len(live) > 2 * k:
            # the candidates ahead so far, scored in full, give a first k-th best score
            ahead = np.argpartition(np.where(own, _least(layout.dtype), partial), -2 * k, axis=1)[:, -2 * k :]
            for q, at in enumerate(ahead):
                at = at[~own[q, at]]
                full = asked[q] @ layout[:, at]
                if len(full) >= k:
                    least[q] = max(least[q], _below(np.partition(full, -k)[-k]))
        rest_q = np.sqrt((asked[:, cut:].astype(float) ** 2).sum(axis=1))
        # a little more than the bound, so that rounding never cuts a candidate off
        hope = partial + rest_q[:, None] * rest_c[cut][live][None, :] * (1 + 1e-6) + 1e-3
        alive = (hope >= least[:, None]) & ~own[:, live] if len(live) < n else (hope >= least[:, None]) & ~own
        if alive.mean() < 0.05:
            q, c = np.nonzero(alive)
            score = partial[q, c] + (asked[q, cut:] * layout[cut:, live[c]].T).sum(axis=1)
            return [_best(query_ids, q, ids[live[c]], score, k)]
        some = alive.any(axis=0)
        if some.mean() < 0.5:
            live, partial = live[some], partial[:, some]
    keep = ~own[:, live] & (np.isinf(least)[:, None] | (partial >= least[:, None]))
    q, c = np.nonzero(keep)
    return [_best(query_ids, q, ids[live[c]], partial[q, c], k)]


def _below(score):
    """A double that isn't above the score, however large that is."""
    return np.nextafter(np.asarray(score, float), -np.inf)


def _least(kind):
    return -np.inf if kind != np.int64 else np.iinfo(np.int64).min


def _best(query_ids, q, candidate, score, k):
    order = np.lexsort((candidate, -score, q))
    q, candidate, score = q[order], candidate[order], score[order]
    first = np.searchsorted(q, np.arange(len(query_ids)))
    keep = np.arange(len(q)) - first[q] < k
    return query_ids[q[keep]], candidate[keep], score[keep].astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` rows of largest inner product for each row whose id is divisible by ``every``.

    Takes ``vec_id`` and ``embedding``; other columns are ignored.  Components become whole
    numbers, floor(``scale`` * x).  Vectors that are null, hold a null or non-finite component,
    or have no id or no components take no part; vectors are candidates for those of the same
    length; of rows that repeat an id the least vector of a length counts; a row isn't its own
    candidate.  An empty table gives an empty one.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``; equal scores go to smaller ids.
    """
    size = vectors.agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("components")).first()
    n_queries = max(1, math.ceil(size["n"] / every / query_block))
    n_candidates = max(1, math.ceil(size["n"] / candidate_block), math.ceil(4 * (size["components"] or 0) / BLOCK_BYTES))
    parallel = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    lanes = min(n_candidates, max(math.ceil(n_candidates / LANE), math.ceil(parallel / n_queries)))
    packed = vectors.select("vec_id", "embedding").mapInArrow(lambda it: _packed(it, scale, n_queries, n_candidates, every), _PACKED)
    all_of = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    asked, block = F.col("query"), F.col("block")
    best = (
        packed.withColumn("query_block", F.explode(F.when(asked, F.array(block)).otherwise(all_of(n_queries))))
        .withColumn("lane", F.explode(F.when(asked, all_of(lanes)).otherwise(F.array((block % lanes).cast("int")))))
        .groupBy("dim", "query_block", "lane")
        .applyInArrow(lambda table: _search_lane(table, k), "query_id long, vec_id long, score long")
    )
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
