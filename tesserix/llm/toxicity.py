"""Toxicity by multiple-instance learning.

A text is a bag of sentences and its label says only whether some sentence offends.  A sentence
scores p = sigmoid(bias + the weights of its distinct words and word beginnings); a text scores by noisy-or, one
minus the product of all 1 - p.  Weights are fitted to the texts' labels by maximum likelihood,
so training itself finds the sentences that account for a label, and the same scores locate
them afterwards.

Only the fit uses a sample: at most ``MAX_LABELLED`` labelled texts of at most ``MAX_BYTES``
together, drawn by a hash of their ids.  One task fits it and only the model comes to the
driver.  Scoring is one pass over the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .cluster import binary_column, filter_rows, flat_binary, row_slices, tidy, whole_rows
from .words import BLOCK, NOT_ALNUM, SAME, Words, distinct, mix, slices

MAX_LABELLED = 12_000
MAX_BYTES = 24_000_000
#: Bytes of a word's beginning, which stand for its stem.
STEM_BYTES = 6
#: Words and beginnings that the model may weigh: those whose sentences differ most between the labels.
MAX_FEATURES = 4_096
#: Least number of different sentences with a word, and of standard errors its log-odds are off.
LEAST_SENTENCES, LEAST_Z = 6, 3.5
STEPS, RATE, RIDGE = 400, 0.1, 2e-4
THRESHOLD = 0.7

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Sentences:
    """The sentences of a batch of texts: runs of words between . ! ? and line ends.

    ``features``: 32-bit hashes of each word and its beginning, two a word; ``sentence``: the
    sentence of each feature; ``text``: each sentence's text; ``start``, ``end``: each
    sentence's bytes in ``words.raw``.
    """

    def __init__(self, texts):
        self.words = words = Words(pc.utf8_lower(texts), separators=NOT_ALNUM, fold=SAME)
        ends = np.zeros(len(words.raw) + 1, np.int64)
        np.cumsum(_ENDS[words.raw], out=ends[1:])
        owner, part = words.owner(), ends[words.start]
        new = np.ones(len(words), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(new)
        self.sentence = np.repeat(np.cumsum(new) - 1, 2)
        self.features = np.stack([words.hash, ~words.prefix_hash(STEM_BYTES)], axis=1).ravel()
        self.features = (self.features >> np.uint64(32)).astype(np.uint32)
        self.text = owner[heads]
        self.start = words.start[heads]
        self.end = words.end[np.append(heads[1:], len(words)) - 1] if len(heads) else heads

    def distinct_words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, code) of the distinct codes, those over 0, of each sentence."""
        on = codes > 0
        width = np.int64(codes.max() + 1) if len(codes) else 1
        pairs = distinct(self.sentence[on] * width + codes[on])
        return pairs // width, pairs % width


@dataclass
class ToxicityModel:
    """Hashes of the features that count (ascending), their weights and the bias."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        size = 1 << max(16, (16 * len(self.vocabulary)).bit_length())
        self.maybe = np.zeros(size, bool)
        self.maybe[self.vocabulary & np.uint32(size - 1)] = True

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words that count, 0 for others."""
        codes = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.maybe[hashes & np.uint32(len(self.maybe) - 1)])
        if len(at) and len(self.vocabulary):
            found = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
            codes[at] = np.where(self.vocabulary[found] == hashes[at], found + 1, 0)
        return codes

    def logits(self, sentences: Sentences) -> np.ndarray:
        """Of each sentence."""
        sentence, code = sentences.distinct_words(self.codes(sentences.features))
        return self.bias + np.bincount(sentence, self.weights[code - 1], minlength=len(sentences.text))

    def score(self, texts) -> tuple[np.ndarray, np.ndarray, Sentences]:
        """Each text's score, each sentence's and the sentences."""
        sentences = Sentences(texts)
        z = self.logits(sentences)
        clean = np.bincount(sentences.text, np.logaddexp(0, z), minlength=len(texts))
        return -np.expm1(-clean), 1 / (1 + np.exp(-z)), sentences


def fit(bags: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> ToxicityModel:
    """Maximum likelihood with a ridge, by Adam over the whole sample.

    ``bags``: of each text its label, its features and how many of them each sentence has.
    Texts whose features are those of an earlier one count once.
    """
    seen, kept = set(), []
    for label, hashes, lengths in bags:
        mark = hashlib.blake2b(hashes.tobytes(), digest_size=16, key=bytes([label > 0])).digest()
        if len(hashes) and mark not in seen:
            seen.add(mark)
            kept.append((label, hashes, lengths))
    del seen
    labels = np.array([b[0] for b in kept], float)
    if not len(kept) or labels.min() == labels.max():
        constant = 0.0 if not len(kept) else labels[0]
        return ToxicityModel(np.empty(0, np.uint32), np.empty(0), 30.0 if constant else -30.0)
    n_sentences = np.array([len(b[2]) for b in kept])
    first = np.append(0, np.cumsum(n_sentences))
    bag_of = np.repeat(np.arange(len(kept)), n_sentences)

    # distinct words of each sentence; one array holds all of them, sorted in place
    pairs, at = np.empty(sum(len(b[1]) for b in kept), np.uint64), 0
    for k in range(len(kept)):
        _, hashes, lengths = kept[k]
        sentence = np.repeat(np.arange(first[k], first[k + 1], dtype=np.uint64), lengths)
        pairs[at : at + len(hashes)] = sentence << np.uint64(32) | hashes
        at += len(hashes)
    n_bags = len(kept)
    del kept, bags
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    sentence, hashes = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
    del pairs
    vocabulary = _screened(sentence, hashes, labels[bag_of] > 0)
    code = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    on = vocabulary[code] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    sentence, code = sentence[on], code[on]
    del hashes, on

    w, bias = np.zeros(len(vocabulary)), float(np.log(labels.mean() / n_sentences.mean()))
    moments = np.zeros((2, len(w) + 1))
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence, w[code], minlength=first[-1])
        clean = np.bincount(bag_of, np.logaddexp(0, z), minlength=n_bags)
        toward = np.where(labels > 0, -1 / np.maximum(np.expm1(clean), 1e-9), 1.0)
        slope = toward[bag_of] / (1 + np.exp(-z)) / n_bags
        gradient = np.append(np.bincount(code, slope[sentence], minlength=len(w)) + RIDGE / 100 * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel(vocabulary, w, bias)


def _screened(sentence: np.ndarray, hashes: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The features that the model weighs, of the distinct ones of each sentence.

    Each different sentence counts once, so copied passages have no more say than others.
    """
    heads = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
    marks = hashes.astype(np.uint64)
    for k in range(0, len(marks), BLOCK):
        marks[k : k + BLOCK] = mix(marks[k : k + BLOCK])
    _, once = np.unique(np.add.reduceat(marks, heads), return_index=True)
    del marks
    fresh = np.zeros(len(positive), bool)
    fresh[sentence[heads[once]]] = True
    counts = [np.unique(hashes[(fresh & kind)[sentence]], return_counts=True) for kind in (positive, ~positive)]
    features = np.union1d(counts[0][0], counts[1][0])
    a, b = (np.full(len(features), 0.5) for _ in range(2))
    for n, (found, times) in zip((a, b), counts, strict=True):
        n[np.searchsorted(features, found)] += times
    odds = np.log(a / b) - np.log((fresh & positive).sum() + 1) + np.log((fresh & ~positive).sum() + 1)
    z = np.abs(odds) / np.sqrt(1 / a + 1 / b)
    good = np.flatnonzero((a + b > LEAST_SENTENCES) & (z > LEAST_Z))
    return np.sort(features[good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]]])


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """A model fitted to the labelled texts that aren't held out.

    ``labels`` has ``doc_id`` and ``toxic``; a text with several labels is toxic if one says
    so.  The sample is the labelled texts whose ids hash lowest, up to either bound; a text that
    would pass ``max_bytes`` is skipped.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # rows that share an id are drawn together
    drawn = (
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
        .join(marked, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.sum("size").alias("size"))
        .where(F.col("size") <= max_bytes)
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id")
        .limit(max_labelled)
        .collect()
    )
    chosen, total = {}, 0
    for row in drawn:
        if total + row["size"] <= max_bytes:
            total += row["size"]
            chosen[row["doc_id"]] = int(row["toxic"] > 0)
    if not chosen:
        return fit([])
    sample = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")

    @tidy
    def bags(batches):
        for batch in batches:
            for part in slices(batch):
                s = Sentences(part.column("text"))
                lengths = np.bincount(s.sentence, minlength=len(s.text)).astype(np.int32)
                by_text = np.searchsorted(s.text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("toxic"),
                        binary_column(s.features, 2 * s.words.bounds), binary_column(lengths, by_text),
                    ],
                    ["doc_id", "toxic", "features", "lengths"],
                )

    # the sample has max_labelled rows of two numbers at most
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = found.mapInArrow(bags, "doc_id long, toxic int, features binary, lengths binary")
    # the sample is bounded, so one task can fit it
    row = found.repartition(1).mapInArrow(_fitted, "vocabulary binary, weights binary, bias double").first()
    if row is None:
        return fit([])
    return ToxicityModel(np.frombuffer(row["vocabulary"], np.uint32), np.frombuffer(row["weights"]), row["bias"])


@tidy
def _fitted(batches):
    rows = []
    for batch in batches:
        ids, labels = (batch.column(c).to_pylist() for c in ("doc_id", "toxic"))
        features, at = flat_binary(batch.column("features"), np.uint32)
        lengths, of = flat_binary(batch.column("lengths"), np.int32)
        rows += [(ids[k], features[at[k] : at[k + 1]], labels[k], lengths[of[k] : of[k + 1]]) for k in range(batch.num_rows)]
    rows.sort(key=lambda r: (r[0], zlib.crc32(r[1])))
    model = fit((r[2], r[1], r[3]) for r in rows)
    yield pa.RecordBatch.from_pydict(
        {"vocabulary": [model.vocabulary.tobytes()], "weights": [model.weights.tobytes()], "bias": [float(model.bias)]}
    )


def score_texts(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; 0 for null and empty texts), ``n_sentences`` and
    ``offending``: sentences that score ``least`` or more, as code points of the text.  Columns
    that had one of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = [c for c in docs.columns if c not in ("score", "n_sentences", "offending")]
    text_at = names.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            for rows, texts in row_slices(batch, text_at):
                scores, by_sentence, s = shared.value.score(texts)
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                for k in np.flatnonzero(by_sentence >= least).tolist():
                    t = int(s.text[k])
                    base = int(s.words.text_bounds[t])
                    lead = s.words.raw[base : s.end[k]]
                    first = (lead & 0xC0) != 0x80
                    start = int(s.start[k]) - base
                    found[t].append({"start": int(first[:start].sum()), "end": int(first.sum()), "score": float(by_sentence[k])})
                n = np.bincount(s.text, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(scores), pa.array(n.astype(np.int64)), pa.array(found, spans)],
                    ["row", "score", "n_sentences", "offending"],
                )

    kept = StructType([f for f in docs.schema.fields if f.name in names])
    added = StructType.fromDDL("score double, n_sentences long, offending array<struct<start:bigint,end:bigint,score:double>>").fields
    schema = StructType([StructField("row", kept), *added])
    return whole_rows(docs, names).mapInArrow(run, schema).select("row.*", "score", "n_sentences", "offending")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """Train on the labelled texts that aren't held out and score all.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Returns a row per input row:
    ``doc_id, held_out, score, predicted`` (1 from ``threshold`` on), ``n_sentences`` and
    ``offending``.  A null doc_id is never held out nor learnt from; null and empty texts
    score 0; without labels of both kinds all texts score alike.
    """
    texts = docs.select("doc_id", "text")
    scored = score_texts(texts, train(texts, labels, **sample))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sample) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``: null and empty
    texts stay, repeated rows stay or go alike, and an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **sample))
    return filter_rows(docs, lambda texts: model.value.score(texts)[0] < threshold)
