"""run() against the stages done plainly, one text at a time."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tesserix.llm import decontaminate, pii, queries, toxicity
from tesserix.llm.words import NOT_ALNUM, Words
from tests.conftest import SF
from tests.llm.test_operators import brute_terms, components, pii_spans


def brute_score(model, text, known):
    """Noisy-or of sentences that are split, and their words counted, one by one."""
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist()))
    clean = 0.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        features = set()
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence):
            if w not in known:
                one = Words(pa.array([w]), separators=NOT_ALNUM)
                known[w] = [int(h >> np.uint64(32)) for h in (one.hash[0], ~one.prefix_hash(toxicity.STEM_BYTES)[0])]
            features.update(known[w])
        if features:
            clean += math.log1p(math.exp(min(700, model.bias + sum(weight.get(f, 0.0) for f in features))))
    return 1 - math.exp(-clean)


def test_pipeline_is_its_stages_done_plainly(spark):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    model, known = toxicity.train(docs, labels), {}
    texts = [(i, t) for i, t in texts if brute_score(model, t, known) < 0.7]
    comp = components(texts)
    texts = [(i, t) for i, t in texts if comp[i][1] == i]

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], np.int64)
    items = [x for x in (coded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if len(x) >= decontaminate.LEAST_WORDS]

    def leaks(t):
        own = coded(t)
        return any(decontaminate.best_substring(x, own)[0] <= int(decontaminate.EDITS * len(x)) for x in items)

    texts = [(i, t) for i, t in texts if not leaks(t)]
    terms = brute_terms(texts)

    def sanitised(i, t):
        spans = sorted([(a, k, pii.KINDS[k], b) for a, k, b in pii_spans(t or "")] + [(a, 4, "term", b) for a, b in terms[i]])
        out, done = "", 0
        for a, _, kind, b in spans:
            if a >= done:
                out += (t or "")[done:a] + f"<{kind}>"
            done = max(done, b)
        return out + (t or "")[done:]

    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for i, t in texts:
        ids = library.encode(sanitised(i, t), add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 100 < len(got) < 200


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, "en", "s", 0), (None, "", None, None, None), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "w " * 30_000, "fr", "s", 60_000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if name != "tokens":
                assert out.columns == docs.columns
                docs = out
