"""Language identification by nearest centroids.

A text is a vector of byte n-grams over its letters, each word between two spaces, in ``DIMENSIONS``
hashed places; a place weighs (1 + log of its count) times its inverse document frequency, and
vectors have length one.  Each language has several centroids, found by spherical k-means.  A text
gets the language of the centroid with the highest cosine, and is rejected where its distance (one
minus that cosine) is beyond the radius that texts of that language and of about its size have.

Document frequencies are counted over all texts to learn from.  Only the clustering uses a sample:
for each language at most ``MAX_TEXTS`` texts and ``MAX_BYTES`` of them, drawn by a hash of their
ids, which one task a language clusters.  The model, ``CLUSTERS`` centroids a language, is broadcast:
its size follows the number of languages, of which there may be ``MAX_LANGUAGES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import tidy
from .toxicity import held_out
from .words import BLOCK, flat_text, slices

SIZES = (1, 2, 3)
BITS = 15
DIMENSIONS = 1 << BITS
CLUSTERS, ROUNDS = 4, 12
MAX_TEXTS, MAX_BYTES = 500, 4_000_000
MAX_LANGUAGES = 256
#: A radius is this share of the distances of a language's own texts in a band of sizes, and some more.
SHARE, SLACK, LEAST_TEXTS = 0.995, 0.05, 20
UNKNOWN = "und"
#: Bands of sizes: powers of two of n-grams.
BANDS = 48

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _spelt(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts' words in lower case, a space on either side of each, and each byte's text."""
    raw, bounds = flat_text(pc.utf8_lower(texts))
    sizes = np.diff(bounds)
    wide = np.full(len(raw) + 2 * len(sizes), 0x20, np.uint8)
    if len(sizes) == 1:
        # of any length, so nothing is held for each byte besides the bytes
        wide[1:-1], text = raw, np.broadcast_to(np.uint32(0), len(wide))
    else:
        text = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes + 2)
        wide[np.arange(len(raw)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = raw
    letter = _LETTERS[wide]
    kept = letter.copy()
    kept[:-1] |= letter[1:]
    kept[bounds[1:] + 2 * np.arange(1, len(bounds)) - 1] = True
    wide[~letter] = 0x20
    return wide[kept], text[kept]


def _places(spelt: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the text of each n-gram of a size."""
    n = len(spelt) - size + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    code = spelt[:n].astype(np.uint32)
    for k in range(1, size):
        code |= spelt[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    code = (code ^ np.uint32(0x9E3779B9 * size & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    code = (code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    whole = text[:n] == text[size - 1 :]
    return (code >> np.uint32(32 - BITS))[whole], text[:n][whole]


@dataclass
class Grams:
    """The different n-grams of a batch of texts, by text and place: ``text, place, count``."""

    n_texts: int
    text: np.ndarray
    place: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Grams":
        spelt, text = _spelt(texts)
        if len(texts) == 1:
            # a text of any length, a block at a time
            total = np.zeros(DIMENSIONS, np.int64)
            for size in SIZES:
                for a in range(0, len(spelt), BLOCK):
                    part = slice(a, a + BLOCK + size - 1)
                    total += np.bincount(_places(spelt[part], text[part], size)[0], minlength=DIMENSIONS)
            place = np.flatnonzero(total)
            return cls(1, np.zeros(len(place), np.int64), place, total[place])
        keys = []
        for size in SIZES:
            place, own = _places(spelt, text, size)
            keys.append((own.astype(np.uint64) << np.uint64(BITS) | place) if len(texts) >> (32 - BITS) else own << np.uint32(BITS) | place)
        keys = np.sort(np.concatenate(keys))
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        count = np.diff(np.append(heads, len(keys)))
        keys = keys[heads].astype(np.int64)
        return cls(len(texts), keys >> BITS, keys & (DIMENSIONS - 1), count)

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """Of each n-gram, such that each text's vector has length one."""
        w = (1 + np.log(self.count)) * idf[self.place]
        size = np.sqrt(np.bincount(self.text, w * w, minlength=self.n_texts))
        return w / size[self.text]

    def sizes(self) -> np.ndarray:
        """N-grams of each text."""
        return np.bincount(self.text, self.count, minlength=self.n_texts).astype(np.int64)


def bands(sizes: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(sizes, 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """``languages`` in order; ``centroids`` (places by centroids) and the language of each;
    ``radii``: languages by bands of sizes."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    radii: np.ndarray

    def nearest(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Each text's language (its index) and cosine; of equal ones the first."""
        best, own = np.zeros(grams.n_texts), np.zeros(grams.n_texts, np.int64)
        if not len(grams.text):
            return best, own
        weights = grams.weights(self.idf).astype(np.float32)
        heads = np.flatnonzero(np.append(True, grams.text[1:] != grams.text[:-1]))
        ends = np.append(heads[1:], len(weights))
        k, room = 0, max(1, (1 << 22) // self.centroids.shape[1])
        while k < len(heads):
            upto = max(k + 1, int(np.searchsorted(ends, heads[k] + room, "right")))
            a, b = heads[k], ends[upto - 1]
            cosines = np.add.reduceat(self.centroids[grams.place[a:b]] * weights[a:b, None], heads[k:upto] - a, axis=0)
            which, texts = np.argmax(cosines, axis=1), grams.text[heads[k:upto]]
            best[texts], own[texts] = np.clip(cosines[np.arange(len(which)), which], 0, 1), self.language_of[which]
            k = upto
        return best, own

    def rejects(self, cosine: np.ndarray, language: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 - cosine > self.radii[language, bands(sizes)]


def cluster(vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length one: spherical k-means, begun with vectors far from each other."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids, own = vectors[chosen], None
    for _ in range(rounds):
        now = np.argmax(vectors @ centroids.T, axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        sums = np.stack([vectors[own == k].sum(axis=0) for k in range(len(centroids)) if (own == k).any()])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        own = own if len(sums) == len(chosen) else None
    return centroids


def radii(distances: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The greatest distance by band that isn't rejected, from those of a language's own texts.

    Smaller texts are farther away, so a band's radius is no less than those of larger texts.  A
    band with few texts takes that of the next larger one, and below the smallest texts that
    were seen nothing is rejected."""
    band, out = bands(sizes), np.full(BANDS, np.nan)
    for b in range(BANDS):
        own = distances[band == b]
        if len(own) >= LEAST_TEXTS:
            out[b] = np.quantile(own, SHARE) + SLACK
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.ones(BANDS)
    least, reach = known[0], 0.0
    for b in range(BANDS - 1, least - 1, -1):
        reach = max(reach, out[b] if not np.isnan(out[b]) else 0.0)
        out[b] = reach
    out[known[-1] + 1 :] = out[known[-1]]
    out[:least] = 1.0
    return out


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts hold each place, and how many texts there are: counted a task at a
    time and added up on the cluster; a number for each place comes to the driver."""

    @tidy
    def count(batches) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(Grams.of(part.column("text")).place, minlength=DIMENSIONS)
                n += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["place", "n"])

    rows = texts.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(DIMENSIONS, np.int64), 0
    for row in rows:
        if row["place"] < 0:
            n = row["n"]
        else:
            out[row["place"]] = row["n"]
    return out, n


def _sample(known: DataFrame, max_texts: int, max_bytes: int) -> DataFrame:
    """``lang, text`` of the texts whose ids hash lowest, up to either bound for each language.
    Texts of over an eighth of ``max_bytes`` are passed over.  Ranks are of ids and sizes alone,
    and each task keeps ``max_texts`` of a language at most before they are dealt by it."""
    drawn = known.withColumn("draw", F.xxhash64(F.lit("sample"), "doc_id")).withColumn("size", F.octet_length("text"))
    drawn = drawn.where(F.col("size") <= max_bytes // 8)
    order = Window.partitionBy("lang").orderBy("draw")
    ranked = drawn.select("lang", "draw", "size").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_texts)
    upto = ranked.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= max_bytes)
    last = upto.groupBy("lang").agg(F.max("draw").alias("last")).limit(MAX_LANGUAGES + 1).collect()
    if len(last) > MAX_LANGUAGES:
        raise ValueError(f"texts to learn from are of over {MAX_LANGUAGES} languages")
    # a row a language, MAX_LANGUAGES at most
    bound = known.sparkSession.createDataFrame([(r["lang"], r["last"]) for r in last], "lang string, last long")
    chosen = drawn.join(F.broadcast(bound), "lang").where(F.col("draw") <= F.col("last"))
    # rows that repeat an id could be any number
    again = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    return chosen.select("lang", "text", "draw").withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= max_texts).select("lang", "text")


def train(docs: DataFrame, max_texts: int = MAX_TEXTS, max_bytes: int = MAX_BYTES) -> LanguageModel | None:
    """A model of the languages ``lang`` of the texts that aren't held out; None without any."""
    learnt = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'").where(~held_out()).select("doc_id", "lang", "text")
    df, n = frequencies(learnt)
    if not n:
        return None
    idf = np.log((n + 1) / (df + 1)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    @tidy
    def fitted(key, table: pa.Table) -> pa.Table:
        texts = table["text"].unique()
        texts = texts.take(pc.sort_indices(texts))
        vectors, sizes, at = np.zeros((len(texts), DIMENSIONS), np.float32), [], 0
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            grams = Grams.of(part.column("text"))
            vectors[at + grams.text, grams.place] = grams.weights(shared.value)
            sizes.append(grams.sizes())
            at += part.num_rows
        centroids = cluster(vectors)
        near = (vectors @ centroids.T).max(axis=1)
        columns = {
            "lang": key, "centroids": [np.ascontiguousarray(centroids, np.float32).tobytes()],
            "radii": [radii(1 - near, np.concatenate(sizes)).tobytes()],
        }
        return pa.table(columns)

    sample = _sample(learnt, max_texts, max_bytes)
    rows = sample.groupBy("lang").applyInArrow(lambda key, table: fitted(key, table), "lang string, centroids binary, radii binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["lang"])
    own = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS) for r in rows]
    return LanguageModel(
        [r["lang"] for r in rows], idf, np.ascontiguousarray(np.concatenate(own).T), np.repeat(np.arange(len(rows)), [len(c) for c in own]),
        np.stack([np.frombuffer(r["radii"]) for r in rows]),
    )


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score, nearest, rejected`` of every text.

    ``nearest`` is the language of the nearest centroid and ``score`` the cosine to it, from 0 to
    1; ``lang_pred`` is the same, or ``und`` where ``rejected`` says that the distance is beyond
    the language's radius.  A text that is null or has no letter, and any without a model, is
    ``und`` with score 0 in both columns and rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "nearest", "rejected"]

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                own, texts = shared.value, part.column("text")
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if own is None:
                    score, nearest, rejected = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
                    lettered[:] = False
                else:
                    grams = Grams.of(texts)
                    score, nearest = own.nearest(grams)
                    rejected = own.rejects(score, nearest, grams.sizes()) | ~lettered
                languages = np.array([*(own.languages if own else []), UNKNOWN], object)
                nearest = np.where(lettered, nearest, len(languages) - 1)
                told = np.where(rejected, len(languages) - 1, nearest)
                columns = [part.column("doc_id"), pa.array(languages[told], pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(languages[nearest], pa.string()), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, nearest string, rejected boolean")


def classify_languages(docs: DataFrame, **sample) -> DataFrame:
    """Train on the texts with a language that aren't held out and tell that of all.

    Takes ``doc_id``, ``text`` and ``lang``; other columns are ignored.  Returns a row per input row,
    with :func:`identify`'s columns and ``held_out``.  A null doc_id is never held out nor learnt
    from; repeated rows get the same values each; an empty table gives an empty one.  Texts are read
    whole, however long.
    """
    return identify(docs, train(docs, **sample)).withColumn("held_out", held_out())
