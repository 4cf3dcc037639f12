"""Language identification: features and centroids against plain versions, held-out accuracy, odd rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserix.llm import langid, queries
from tests.conftest import SF
from tests.llm.test_operators import ODD, docs_of


def spelt(text):
    """A text's words between spaces, byte by byte."""
    raw = "".join(text.lower()).encode()
    kept = bytes(b if langid._LETTERS[b] else 0x20 for b in raw)
    words = kept.split()
    return (b" " + b" ".join(words) + b" ") if words else b" "


def place(gram):
    code = int.from_bytes(gram, "little") ^ (0x9E3779B9 * len(gram) & 0xFFFFFFFF)
    code = code * 0x85EBCA6B & 0xFFFFFFFF
    code = (code ^ (code >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return code >> (32 - langid.BITS)


def grams(text):
    own = spelt(text)
    return Counter(place(own[k : k + n]) for n in langid.SIZES for k in range(len(own) - n + 1))


TEXTS = ["Uno, dos!", "", "  ... ", "ÀÉ straße 12 words", "x", "one two  three\nfour"]


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_grams_are_those_of_words_between_spaces(block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    for batch in [TEXTS, *([t] for t in TEXTS)]:
        found = langid.Grams.of(pa.array(batch))
        got = [Counter() for _ in batch]
        for t, p, n in zip(found.text.tolist(), found.place.tolist(), found.count.tolist(), strict=True):
            got[t][p] += n
        assert got == [grams(t) for t in batch]
    assert langid.Grams.of(pa.array([None, "a"], pa.string())).sizes().tolist() == [1, sum(grams("a").values())]


def plain_vector(text, idf):
    v = np.zeros(langid.DIMENSIONS)
    for p, n in grams(text).items():
        v[p] = (1 + np.log(n)) * idf[p]
    return v / np.linalg.norm(v)


def test_nearest_is_the_highest_cosine(monkeypatch):
    rng = np.random.default_rng(2)
    idf = 1 + rng.random(langid.DIMENSIONS)
    seeds = ["der die das und ist nicht", "the and of is not for", "le la les et ne pas", "el los las y no es", "il lo gli e non che"]
    centroids = np.stack([plain_vector(s, idf) for s in seeds])
    model = langid.LanguageModel(["a", "b", "c"], idf, np.ascontiguousarray(centroids.T, np.float32), np.array([0, 0, 1, 2, 2]), np.full((3, langid.BANDS), 0.5))
    texts = [*TEXTS, *seeds, "die nicht la", "los e"]
    cosine, own = model.nearest(langid.Grams.of(pa.array(texts)))
    for k, t in enumerate(texts):
        want = centroids @ plain_vector(t, idf)
        assert abs(cosine[k] - want.max()) < 1e-5 and (want.max() == 0 or own[k] == model.language_of[int(np.argmax(want))])
    sizes = langid.Grams.of(pa.array(texts)).sizes()
    assert model.rejects(cosine, own, sizes).tolist() == [1 - c > 0.5 for c in cosine.tolist()]


def test_clusters_find_groups():
    rng = np.random.default_rng(5)
    axes = np.eye(40)[:4]
    vectors = np.concatenate([a + 0.05 * rng.random((30, 40)) for a in axes])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    found = langid.cluster(vectors, clusters=4)
    assert sorted(np.argmax(found, axis=1).tolist()) == [0, 1, 2, 3]
    assert np.allclose(np.linalg.norm(found, axis=1), 1)
    assert len(langid.cluster(vectors[:2], clusters=4)) == 2


def test_radii_shrink_with_size():
    sizes = np.repeat([10, 100, 1000], 40)
    distances = np.concatenate([np.full(40, 0.7), np.full(40, 0.4), np.full(40, 0.5)])
    r = langid.radii(distances, sizes)
    slack = langid.SLACK
    assert np.allclose(r[[3, 6, 9, 12]], [0.7 + slack, 0.5 + slack, 0.5 + slack, 0.5 + slack]) and r[0] == 1.0
    assert (np.diff(r) <= 1e-12).all() and (langid.radii(distances[:3], sizes[:3]) == 1).all()


def language(seed, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Two invented languages, one written in two alphabets, and a third nobody has labelled."""
    ab, cd, ab2, other = language(1, "abcdefgh"), language(2, "mnopqrst"), language(3, "абвгдежз"), language(4, "ⲁⲃⲅⲇⲉⲍ")
    rng = random.Random(9)
    rows = []
    for k in range(600):
        own = [("xx", ab), ("yy", cd), ("xx", ab2)][k % 3]
        rows.append((k, own[1](rng.randint(20, 80)), own[0]))
    return rows, [(1000 + k, other(60)) for k in range(20)]


def test_held_out_texts_of_several_alphabets(spark, corpus):
    rows, foreign = corpus
    docs = spark.createDataFrame([*rows, *((i, t, None) for i, t in foreign)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.classify_languages(docs.repartition(3)).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert 150 < len(held) < 250
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]) >= 0.97 * len(held)
    assert all(got[i]["nearest"] == lang for i, _, lang in rows)
    # far from all centroids
    assert all(got[i]["rejected"] and got[i]["lang_pred"] == "und" and got[i]["nearest"] in ("xx", "yy") for i, _ in foreign)


def test_languages_of_held_out_documents_are_not_learnt(spark, corpus):
    rows, _ = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", langid.held_out())
    known = docs.withColumn("lang", F.when(~F.col("held"), F.col("lang")).otherwise("zz"))
    one, two = (sorted(tuple(r) for r in langid.classify_languages(d).collect()) for d in (docs, known))
    assert one == two


def test_samples_are_bounded_and_repeated_rows_change_nothing(spark, corpus):
    rows, _ = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = Counter(r["lang"] for r in langid._sample(docs, 25, 1 << 20).collect())
    assert drawn == {"xx": 25, "yy": 25}
    most = max(len(t.encode()) for _, t, _ in rows)
    small = langid._sample(docs, 500, 8 * most).collect()
    by_lang = Counter()
    for r in small:
        by_lang[r["lang"]] += len(r["text"].encode())
    assert 0 < len(small) < 100 and max(by_lang.values()) <= 8 * most
    again = docs.unionAll(docs.where("doc_id = 4")).unionAll(docs.where("doc_id = 4"))
    assert Counter(r["lang"] for r in langid._sample(again, 25, 1 << 20).collect()) == drawn


def test_frequencies_count_texts(spark):
    df, n = langid.frequencies(spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(4))
    want = Counter(p for t in TEXTS for p in grams(t))
    assert n == 3 * len(TEXTS) and {p: int(df[p]) for p in np.flatnonzero(df)} == {p: 3 * c for p, c in want.items()}


def test_odd_rows(spark):
    docs = docs_of(spark, [*ODD, (7, "<<< 123 >>>"), (8, "one w alpha beta é")]).withColumn("lang", F.when(F.col("doc_id") >= 4, "xx"))
    rows = langid.classify_languages(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["nearest"] in ("xx", "und")
        if r["doc_id"] in (1, 2, 3, 7):
            assert (r["lang_pred"], r["nearest"], r["score"], r["rejected"]) == ("und", "und", 0.0, True)
        else:
            assert r["nearest"] == "xx"
    assert len({tuple(r) for r in rows if r["doc_id"] == 4}) == 1
    # nothing to learn from, and no rows
    unknown = langid.classify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    assert langid.classify_languages(docs.where("false")).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k % 7}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 2 languages"):
        langid.train(docs)


def test_query_returns_learned_languages(spark):
    rows = queries.op13_langid(spark, SF).collect()
    learned = {r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang").distinct().collect()}
    assert {r["lang_pred"] for r in rows} <= {*learned, "und"}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
