"""Each operator against a brute-force version and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserix.llm import bpe, cluster, decontaminate, jaccard, licenses, pii, queries, repeats, secrets, topk, toxicity, warc
from tests.conftest import SF

#: Names that operators use inside, and one that needs quotes.
CLASHING = """batch node text_key tokens keys component gone least rows row key base found words near counts entities terms held entity
copies score offending label n_sentences n_shingles missing cool home comp rules row_key spans toxic n_words low grams query part `a.b c`""".split()
CLASHING = [*CLASHING[:-2], "a.b `c"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{cluster.quoted(c)} string" for c in CLASHING)


def docs_of(spark, texts):
    """Rows with extra columns whose names some operator uses inside."""
    return spark.createDataFrame([(i, t, *CLASHING) for i, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta"), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "w " * 50_000), (6, "é😀 ü")]


def sets(texts, size=5):
    out = {}
    for i, t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def components(texts, percent=75):
    s = sets(texts)
    comp = {i: i for i in s}
    changed = True
    ids = sorted(s)
    links = [(a, b) for a in ids for b in ids if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(s[i]), comp[i]) for i in s}


def near_copies(seed, n_groups=6, n_plain=30, group=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(n_plain)]
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randint(20, 80))]
        for _ in range(group):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    shared = [word() for _ in range(40)]
    texts += [" ".join(shared + [word() for _ in range(k)]) for k in range(0, 30, 2)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block", "common"), [(1, 4096, 2048), (2, 8, 2), (3, 3, 4)])
def test_jaccard_components(spark, seed, block, common):
    texts = near_copies(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs_of(spark, texts), block=block, common=common).collect()}
    assert got == components(texts)
    left = {r[0] for r in jaccard.drop_near_duplicates(docs_of(spark, texts), block=block, common=common).collect()}
    assert left == {c for _, c in got.values()}


def test_jaccard_takes_any_id(spark):
    same = "a b c d e f g h i j"
    high = 2**62
    texts = [(high + 5, same), (-(2**63), "x y"), (2**63 - 1, same), (None, same), (-7, "p q r s t u v"), (None, "p q r s t u v"), (None, "only one"), (None, "only one")]
    rows = Counter(tuple(r) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect())
    assert rows == Counter(
        [(high + 5, 6, high + 5), (-(2**63), 1, -(2**63)), (2**63 - 1, 6, high + 5), (None, 6, high + 5), (-7, 3, -7), (None, 3, -7)] + [(None, 1, None)] * 2
    )


def test_jaccard_merges_are_plain_counts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 30))
        held = [np.unique(rng.integers(0, 40, rng.integers(1, 25))) for _ in range(n)]
        bounds = np.append(0, np.cumsum([len(x) for x in held]))
        search = jaccard.Search(np.concatenate(held).astype(np.uint64), bounds, np.diff(bounds), np.arange(n), n, 75)
        at, least = rng.choice(len(search.names), min(len(search.names), 9), replace=False), int(rng.integers(1, 5))
        want = Counter(i for t in at for i in range(n) if search.names[t] in held[i])
        for merge in (search._merge_skip, search._merge_runs):
            found, times = merge(at, least)
            assert dict(zip(found.tolist(), times.tolist())) == {i: c for i, c in want.items() if c >= least}


def test_jaccard_of_a_common_line_stays_linear(spark):
    """Texts of a line that all have and a number of their own, none linked, and pairs of them that are."""
    docs = spark.range(12_000).selectExpr("id doc_id", "concat('a line that all of them have in common ', id) text")
    docs = docs.union(docs.selectExpr("doc_id + 1000000", "text || ' x'"))
    rows = jaccard.jaccard_components(docs).select("n_shingles", (F.col("doc_id") == F.col("component_id")).alias("own")).groupBy("n_shingles", "own").count().collect()
    assert {tuple(r) for r in rows} == {(6, True, 12_000), (7, False, 12_000)}


def test_jaccard_on_odd_rows(spark):
    docs = docs_of(spark, [*ODD, (7, "a b c d e f"), (None, "a b c d e f"), (None, "A b c d e f")])
    rows = jaccard.jaccard_components(docs).collect()
    assert len(rows) == 11
    assert Counter(r for r in rows if r[0] is None) == Counter({(None, 2, None): 1, (None, 2, 7): 2})
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1})
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [2, 5, 6, 35])
def test_repeats(spark, window):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcd") + str(rng.randrange(30)) for _ in range(rng.randint(3, 60))) for _ in range(6)]
    texts = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30)))) for i in range(60)]
    texts += [(100, "x " * 100), (101, None), (102, "")]
    got = repeats.remove_repeats(docs_of(spark, texts), window=window).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(texts, window))


def test_repeats_on_odd_rows(spark):
    rows = repeats.remove_repeats(docs_of(spark, ODD), window=3).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in rows) == Counter({(1, 0): 1, (2, 0): 1, (None, 0): 1, (3, 0): 1, (4, 0): 2, (5, 50_000): 1, (6, 0): 1})
    assert repeats.remove_repeats(docs_of(spark, []), window=3).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_best_substring_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, t = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 12))
        edits, a, b = decontaminate.best_substring(p, t)
        want = min(edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert edits == want == edit_distance(p, t[a:b])


def nearest_ends(pattern, text):
    """Fewest edits between the pattern and any passage that ends after each word, by the plain recurrence."""
    row = list(range(len(pattern) + 1))
    out = [row[-1]]
    for w in text:
        last, row = row, [0]
        for k, p in enumerate(pattern):
            row.append(min(last[k] + (p != w), last[k + 1] + 1, row[k] + 1))
        out.append(row[-1])
    return out


def test_decontamination_rows_are_those_of_plain_edit_distances(spark):
    """Which passages are found, with how many edits and where, against all items and texts one by one."""
    rng = random.Random(14)
    words = [f"w{k}" for k in range(300)]
    items = [(k, rng.choices(words, k=rng.randint(8, 45))) for k in range(25)]
    texts = []
    for k in range(60):
        t = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(k % 3):
            w = list(rng.choice(items)[1])
            for _ in range(int(rng.choice([0, 0.1, 0.2, 0.35]) * len(w))):
                at = rng.randrange(len(w))
                rng.choice((lambda: w.pop(at), lambda: w.insert(at, rng.choice(words)), lambda: w.__setitem__(at, rng.choice(words))))()
            t += w + rng.choices(words, k=rng.randint(20, 40))
        texts.append((k, t))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows = decontaminate.find_leaks(docs_of(spark, [(i, " ".join(w)) for i, w in texts]), bench).collect()
    by_id, item_of = dict(texts), dict(items)
    for r in rows:
        passage = by_id[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
        assert r["n_edits"] == edit_distance(np.array(item_of[r["item_id"]]), np.array(passage)) and r["n_item_words"] == len(item_of[r["item_id"]])
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["item_id"]), []).append(r["n_edits"])
    want = {(i, m): min(nearest_ends(item, t)) for i, t in texts for m, item in items}
    want = {pair: n for pair, n in want.items() if n <= int(decontaminate.EDITS * len(item_of[pair[1]]))}
    # what is found is right to the edit, and all but a hundredth at the most edits is found
    assert {p: min(n) for p, n in got.items()} == {p: n for p, n in want.items() if p in got}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 25


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 50)))) for k in range(40)]
    filler = lambda: " ".join(word() for _ in range(60))
    texts, planted = [], set()
    for k, item in items:
        w = item.split()
        for _ in range(int(0.15 * len(w))):
            at = rng.randrange(len(w))
            rng.choice((lambda: w.pop(at), lambda: w.insert(at, word()), lambda: w.__setitem__(at, word())))()
        texts.append((k, filler() + ". " + " ".join(w).upper() + "! " + filler()))
        planted.add((k, k))
    texts += [(100 + k, filler()) for k in range(40)]
    bench = spark.createDataFrame([*items, (99, None), (None, "x y z"), (98, "too few words")], "item_id long, text string")
    rows = decontaminate.find_leaks(docs_of(spark, [*texts, *ODD]), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found <= planted and len(found) >= 0.97 * len(planted)
    clean = {r[0] for r in decontaminate.drop_leaks(docs_of(spark, texts), bench).collect()}
    assert clean == {i for i, _ in texts} - {i for i, _ in found}
    assert decontaminate.find_leaks(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs_of(spark, []), bench).count() == 0


@pytest.mark.parametrize("length", [15, 30, 60, 100])
def test_decontamination_recall_at_the_most_edits(length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 5)))
    items = [[word() for _ in range(length)] for _ in range(100)]
    bench = decontaminate.Benchmark(list(range(100)), [" ".join(w) for w in items])
    shares = []
    for edit in (lambda w, at: w.pop(at), lambda w, at: w.insert(at, word()), lambda w, at: w.__setitem__(at, word())):
        texts = []
        for item in items:
            w = list(item)
            for at in sorted(rng.sample(range(length), int(0.2 * length)), reverse=True):
                edit(w, at)
            texts.append(" ".join([word() for _ in range(30)] + w + [word() for _ in range(30)]))
        found = {m[:2] for m in bench.matches(decontaminate._words(pa.array(texts)))}
        shares.append(len(found & {(k, k) for k in range(100)}) / 100)
    assert min(shares) >= 0.97 and sum(shares) >= 3 * 0.985


def test_decontamination_recall_in_a_benchmark_of_all_lengths():
    """Every length from 1 to 60 words at exactly the edits it is allowed, of each kind."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 6)))
    items = [[word() for _ in range(n)] for n in range(1, 61) for _ in range(16)]
    bench = decontaminate.Benchmark(list(range(len(items))), [" ".join(w) for w in items])
    place = {item: k for k, (item, _) in enumerate(bench.items)}
    for edit in (lambda w, at: w.pop(at), lambda w, at: w.insert(at, word()), lambda w, at: w.__setitem__(at, word())):
        texts = []
        for item in items:
            w = list(item)
            edits = bench.allowed(len(w)) if len(w) >= decontaminate.LEAST_WORDS else 0
            for at in sorted(rng.sample(range(len(w)), edits), reverse=True):
                edit(w, at)
            texts.append(" ".join([word() for _ in range(20)] + w + [word() for _ in range(20)]))
        found = {m[:2] for m in bench.matches(decontaminate._words(pa.array(texts)))}
        hit = np.array([(k, place[k]) in found for k in range(len(items))]).reshape(15, -1)  # four lengths a cell
        assert hit.mean(axis=1).min() >= 0.97 and hit.mean() >= 0.99


def test_decontamination_of_a_very_long_item(spark):
    import pickle

    rng = random.Random(2)
    long = [f"w{rng.randrange(10**9)}" for _ in range(20_000)]
    bench = decontaminate.Benchmark([1], [" ".join(long)])
    assert len(pickle.dumps(bench)) < 20 << 20
    edited = [w if rng.random() < 0.85 else "zz" for w in long]
    table = spark.createDataFrame([(1, " ".join(long)), (2, "a few words that nobody will find there")], "item_id long, text string")
    texts = [(1, " ".join(edited)), (2, " ".join(long[:15_000])), (3, "so " + " ".join(long) + " it is")]
    rows = decontaminate.find_leaks(docs_of(spark, texts), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (3, 1)}


@pytest.mark.parametrize("low", [19, 24])
def test_decontamination_of_lengths_that_may_keep_fewer_pairs(low):
    rng = random.Random(low)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(5, 7)))
    items = [[word() for _ in range(low + (k > 0))] for k in range(80)]
    bench = decontaminate.Benchmark(list(range(80)), [" ".join(w) for w in items])
    texts = []
    for item in items[1:]:
        w = list(item)
        for at in range(3, 4 * bench.allowed(len(w)) + 3, 4):
            w[at] = word()
        texts.append(" ".join([word() for _ in range(30)] + w + [word() for _ in range(30)]))
    found = {m[:2] for m in bench.matches(decontaminate._words(pa.array(texts)))}
    assert len(found & {(k, k + 1) for k in range(79)}) >= 0.97 * 79


def test_decontamination_finds_short_items_word_for_word(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "who wrote it"), (3, "Zyx"), (4, "who wrote hamlet"), (5, "a a"), (6, ""), (7, "what is the largest moon of Saturn")]
    texts = [(1, "so who WROTE, hamlet then"), (2, "who wrote"), (3, "hamlet zyx"), (4, "a a a a a b a a"), (5, "what is the largest moon of Saturn"), (6, "what is the largest moon of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [tuple(r) for r in decontaminate.find_leaks(docs_of(spark, [*texts, (7, None)]).coalesce(1), bench).collect()]
    assert sorted(rows) == [(1, 1, 0, 3, 1, 3), (1, 4, 0, 3, 1, 3), (3, 3, 0, 1, 1, 1), (4, 5, 0, 2, 0, 2), (4, 5, 0, 2, 6, 2), (5, 7, 0, 7, 0, 7)]
    assert {r[0] for r in decontaminate.drop_leaks(docs_of(spark, texts), bench).collect()} == {2, 6}


def test_bpe_is_the_library_s(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = list(" \n\t\r\x0b\x1c\x85\xa0　abXY'sellre01½Ⅷ一éñ😀́‍.,<|>") + ["<|endoftext|>", "'ll", "  "]
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for k in range(800)]
    texts += [(1000, "a" * 20_000), (1001, None), (1002, ""), (1003, " " * 3000 + "x"), (None, "Hello, hello")]
    got = {r["doc_id"]: r for r in bpe.tokenize(docs_of(spark, texts), path).collect()}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_bpe_on_odd_rows(spark):
    path = queries.tokenizer_path()
    rows = bpe.tokenize(docs_of(spark, ODD), path).collect()
    by_id = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows)
    assert len(rows) == len(ODD) and by_id[(4, *next((r["n_tokens"], r["ids_sha256"]) for r in rows if r["doc_id"] == 4))] == 2
    assert {r["doc_id"]: r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1: 0, 2: 0}
    assert bpe.tokenize(docs_of(spark, []), path).count() == 0


def test_bpe_applies_ranks_in_order_to_runs_of_one_symbol():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, own = Tokenizer.from_file(path), bpe.Tokenizer(path)
    rng = random.Random(3)
    texts = ["a" * k for k in range(40)] + ["".join(rng.choice("ahe ") * rng.randint(1, 9) for _ in range(60)) for _ in range(200)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(30_000)))  # one long piece
    assert [ids.tolist() for ids in own.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_toxicity_learns_from_texts_and_finds_sentences(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnr") for _ in range(4))
    sentence = lambda *extra: " ".join([*(word() for _ in range(6)), *extra])
    texts, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        parts = [sentence() for _ in range(rng.randint(1, 8))]
        if bad:
            parts[rng.randrange(len(parts))] = sentence(rng.choice(["vilewort", "grimfoul"]))
        texts.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    labels = spark.createDataFrame([*labels, (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.classify(docs_of(spark, [*texts, (1001, None), (1002, ""), (None, "a vilewort")]), labels).collect()}
    import zlib

    held = [r for i, r in rows.items() if i is not None and i < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items() if i is not None)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) and len(held) > 200
    text = dict(texts)
    for r in held:
        for o in r["offending"]:
            assert re.search("vilewort|grimfoul", text[r["doc_id"]][o["start"] : o["end"]])
    assert (rows[1001]["score"], rows[1002]["score"], rows[None]["held_out"], rows[None]["predicted"]) == (0, 0, False, 1)
    clean = toxicity.drop_toxic(docs_of(spark, texts), labels)
    assert clean.columns == docs_of(spark, []).columns and clean.where("doc_id % 4 = 0").count() == 0
    none = toxicity.classify(docs_of(spark, texts[:5]), labels.limit(0)).collect()
    assert all(r["predicted"] == 0 for r in none) and toxicity.classify(docs_of(spark, []), labels).count() == 0


def test_toxicity_fit_is_at_the_optimum_of_the_plain_likelihood():
    """The penalised likelihood, counted text by text and word by word, has no slope where the fit ends."""
    import math

    rng = random.Random(6)
    bad, plain = [f"bad{k}" for k in range(4)], [f"word{k}" for k in range(30)]
    texts = []
    for k in range(240):
        sentences = [[rng.choice(plain) for _ in range(5)] for _ in range(rng.randint(1, 4))]
        if k % 3 == 0 or rng.random() < 0.05:
            rng.choice(sentences)[rng.randrange(5)] = rng.choice(bad)
        texts.append((int(k % 3 == 0 or rng.random() < 0.03), ". ".join(" ".join(s) for s in sentences)))
    bags = []
    for label, text in texts:
        s = toxicity.Sentences(pa.array([text]))
        bags.append((label, s.features, np.bincount(s.sentence, minlength=len(s.text)).astype(np.int32)))
    model = toxicity.fit(bags)
    weight = {f"{w}": 0.0 for w in bad}
    vocabulary = model.vocabulary.tolist()
    assert len(vocabulary) >= len(weight)
    per_text = {}
    for label, features, lengths in bags:
        if (label, features.tobytes()) not in per_text:
            cut = np.split(features, np.cumsum(lengths)[:-1])
            per_text[label, features.tobytes()] = (label, [set(c.tolist()) & set(vocabulary) for c in cut])

    def loss(weights, bias):
        total = 0.0
        for label, sentences in per_text.values():
            clean = sum(math.log1p(math.exp(bias + sum(weights[f] for f in s))) for s in sentences)
            total += -math.log(-math.expm1(-clean)) if label else clean
        return total / len(per_text) + toxicity.RIDGE / 200 * sum(w * w for w in weights.values())

    at, bias, h = dict(zip(vocabulary, model.weights.tolist())), model.bias, 1e-4
    slopes = [(loss(at, bias + h) - loss(at, bias - h)) / (2 * h)]
    for f in vocabulary:
        slopes.append((loss(at | {f: at[f] + h}, bias) - loss(at | {f: at[f] - h}, bias)) / (2 * h))
    assert max(map(abs, slopes)) < 2e-3
    # and no step of a plain descent from there lowers it by much
    lower = loss({f: w - 5 * g for (f, w), g in zip(at.items(), slopes[1:])}, bias - 5 * slopes[0])
    assert loss(at, bias) - lower < 1e-4


def test_toxicity_scores_long_texts_and_repeated_rows(spark):
    """Scores of texts of many blocks are those of their sentences, and repeated rows score alike."""
    rng = random.Random(2)
    plain = lambda *more: " ".join([*("".join(rng.choice("aeioulmnr") for _ in range(4)) for _ in range(6)), *more])
    texts = [(k, ". ".join([plain(), plain("grimfoul") if k % 4 == 0 else plain(), plain()])) for k in range(900)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    long = (plain() + ". ") * 40_000
    rows = [(1500, long), (1501, long + "you grimfoul alpha."), (1502, texts[4][1]), (1502, texts[4][1])]
    got = toxicity.score_texts(docs_of(spark, rows).select("doc_id", "text"), model).collect()
    scores = {i: {r["score"] for r in got if r["doc_id"] == i} for i, _ in rows}
    want = {i: float(model.score(pa.array([t]))[0][0]) for i, t in rows}
    assert all(len(s) == 1 and abs(next(iter(s)) - want[i]) < 1e-12 for i, s in scores.items())
    spans = next(r["offending"] for r in got if r["doc_id"] == 1501)
    assert [rows[1][1][s["start"] : s["end"]] for s in spans] == ["you grimfoul alpha"]


def test_toxicity_sample_skips_long_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulmnr") for _ in range(4))
    texts = [(i, ". ".join(" ".join([*(word() for _ in range(6)), *["vilewort"] * (i % 4 == 0)]) for _ in range(3))) for i in range(400)]
    texts += [(i, f"{word()} " * 20_000) for i in range(400, 460)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels, max_bytes=90_000)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs_of(spark, texts[:400]).select("doc_id", "text"), model).collect()}
    assert all((scores[i] >= 0.7) == (i % 4 == 0) for i in range(400))


def test_licenses(spark):
    texts = [
        *ODD,
        (20, "CC BY and cc-by. All rights reserved; all RIGHTS reserved"),
        (21, "Licensed under the Apache (new) License, Version 2.0 today"),
        (22, "the general public licence is not a license"),
        (23, "x GNU General Public License"),
        (24, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert tuple(rows[20])[1:] == (11, 4, 0, 8, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert (rows[21]["labels"], rows[21]["base_labels"], rows[21]["n_base"]) == ("apache-2.0", "", 0) and 0.6 <= rows[21]["score"] < 1
    assert rows[22]["labels"] == "" and rows[22]["first_word"] is None and rows[22]["score"] == 0
    assert (rows[23]["first_word"], rows[23]["labels"]) == (2, "gpl") and rows[24]["labels"] == "mit"
    assert rows[5]["n_words"] == 50_000 and rows[1]["n_words"] == 0 and rows[None]["n_words"] == 6
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def test_licenses_take_whole_texts_of_any_length(spark):
    from tesserix.llm.license_texts import MIT

    rng = random.Random(5)
    words = licenses.template_words(MIT)
    long = [f"w{rng.randrange(400)}" for _ in range(1500)]
    edited = [w for k, w in enumerate(words) if k % 29]
    texts = [
        (1, "x y " + MIT), (2, " ".join(edited)), (3, " ".join(words[:40])), (4, " ".join(["a", "b", *long, "c"])),
        (5, " ".join(long[:1000])), (6, " ".join(long[:800])), (7, " ".join(long[::-1])), (None, " ".join(long)),
    ]
    templates = [("mit", MIT), ("long", " ".join(long)), ("two", "p q")]
    found = licenses.find_licenses(docs_of(spark, texts), templates).where("NOT base").collect()
    got = {r["doc_id"]: (r["label"], r["start"], r["end"], round(r["covered"], 3)) for r in found}
    kept = sum(words[k : k + 3] == edited[j : j + 3] for k in range(len(words) - 2) for j in range(max(0, k - 8), min(len(edited) - 2, k + 1)))
    assert got.pop(2)[0::3] == ("mit", pytest.approx(kept / (len(words) - 2), abs=0.02))
    assert got == {
        1: ("mit", 2, 2 + len(words), 1.0), 4: ("long", 2, 1502, 1.0), 5: ("long", 0, 1000, round(998 / 1498, 3)), None: ("long", 0, 1500, 1.0),
    }
    with pytest.raises(ValueError, match="two words"):
        licenses.find_licenses(docs_of(spark, texts), [("one", "word")])


@pytest.mark.parametrize("gram", [2, 4])
def test_licenses_by_other_grams(spark, gram):
    texts = [(1, "xx cc by yy"), (2, "all rights reserved"), (3, "general public license cc"), (4, "this is free and unencumbered software released into the public domain by")]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(spark, texts), gram=gram).collect()}
    assert [(rows[i]["n_base"], rows[i]["labels"]) for i in (1, 2, 3, 4)] == [(1, "cc-by"), (1, "reserved"), (1, "gpl"), (0, "unlicense")]


ASSIGN = re.compile(r"""((?:%s))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))


def secret_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(6)
    parts = ["token=", "Token : '", "secret", "api_key\": \"", "APIKEY=", "abcdef", "abc", "=", " ", "é", "😀", "\n", "AKIA", "ABCDEFGH", "0123456789abcdef", "zz", "."]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(400)]
    texts += [(1000 + k, t) for k, t in enumerate(["token=token: abcdefgh", None, "", "ghp_" + "a" * 40, "-----BEGIN RSA PRIVATE KEY-----"])]
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(docs_of(spark, [*texts, (None, "secret=abcdefg")])).collect()}
    for i, t in texts:
        want = secret_spans(t or "")
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in want) for k in range(3)]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
    assert rows[1003]["spans"] == "github:0:44,hex:4:44" and rows[1004]["spans"] == "private_key:0:31" and rows[None]["n_assign"] == 1
    assert secrets.scan_secrets(docs_of(spark, [])).count() == 0


def test_secrets_by_either_join_and_in_long_texts(spark):
    key = "0123456789abcdef" * 2
    texts = [(1, f"token={key} " * 3000), (1, "token = abcdefg"), (2, f"{key} " * 3000 + "AKIA" + "Q" * 16), (None, "passwd: 'zzzzzz'"), (None, "passwd: 'zzzzzz'"), (3, None), (4, "token=")]
    want = Counter((i, *[sum(s[1] == k for s in secret_spans(t or "")) for k in range(3)]) for i, t in texts)
    for rows in (10, 0):
        found = secrets.scan_secrets(docs_of(spark, texts), broadcast_rows=rows).collect()
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) for r in found) == want
        long = next(r for r in found if r["doc_id"] == 2)
        assert [(s["start"], s["end"]) for s in long["found"]] == [(a, b) for a, _, _, b in secret_spans(texts[2][1])]


def test_secrets_of_other_rules(spark):
    rules = [secrets.Rule("ticket", "ABC[0-9]+", 0, 10), secrets.Rule("pin", "(?:x|yy)#([0-9]+)", 1, 4), secrets.Rule("any", "[0-9]*%[0-9]+", 0, 3)]
    texts = [(1, "ABC1234567 ABC123456"), (2, "x#1234 yy#123 yy#12345"), (3, "12%3 %1 %12"), (4, "abc1234567")]
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs_of(spark, texts), rules).collect()}
    assert rows == {1: "ticket:0:10", 2: "pin:0:6,pin:14:22", 3: "any:0:4,any:8:11", 4: ""}


def test_trigram_queries_hold_for_every_match():
    samples = {"assign": "x Api_Key='abc123'", "access": "AKIA" + "B" * 16, "private_key": "-----BEGIN EC PRIVATE KEY-----", "github": "gho_" + "x" * 36,
               "slack": "xoxb-1234567890", "google": "AIza" + "Z" * 35, "stripe": "sk_live_" + "q" * 16, "jwt": "eyJabcdefgh.eyJabcdefgh.abcdefgh"}
    for rule in secrets.BASE + secrets.ISSUED:
        clauses = secrets.trigram_query(rule.pattern)
        if rule.kind == "hex":
            assert clauses == []
            continue
        low = samples[rule.kind].lower()
        assert re.search(rule.pattern, samples[rule.kind]) and clauses
        assert all(any(all(g in low for g in grams) for grams in clause) for clause in clauses)


def pii_spans(text):
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, text) if ok(m[0]))


def test_pii_base_spans():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", ".", "12", "1.2.3.4", "300", "4111 1111 1111 1111", "+1 ", "(555) ", "-", " ", "x@y.zz", "é", "0", "+"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == pii_spans(text)
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def free_words(t):
    """(start, end, word) of the words outside personal data, and of all."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    return [(s, e, w) for s, e, w in words if not any(s < b and e > a for a, _, b in pii_spans(t))], words


def brute_sources(texts):
    """Each text's source: texts that share two min-hashes side by side take the least number, step by step."""
    marks = {}
    for t in {t for t in texts if t and pii_spans(t)}:
        words = [w for _, _, w in free_words(t)[0]]
        shingles = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        digests = [[hashlib.sha256((own + s).encode()).hexdigest() for s in shingles] for own in "01"]
        least = [min(d[8 * k : 8 * k + 8] for d in ds) for ds in digests for k in range(8)]
        marks[t] = {(k, least[2 * k], least[2 * k + 1]) for k in range(8)}
    source = {t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in marks}
    for _ in range(pii.SPREAD):
        least = {}
        for t, own in marks.items():
            for m in own:
                least[m] = min(least.get(m, source[t]), source[t])
        source = {t: min(least[m] for m in own) for t, own in marks.items()}
    return source


def brute_terms(texts, disclosure=pii.DISCLOSURE):
    """Terms that disclose an entity, by counting everything plainly."""
    import math

    held, df, both, seen, from_source, sources = Counter(), Counter(), Counter(), [], {}, brute_sources([t for _, t in texts])
    for _, t in texts:
        (free, words), spans = free_words(t or ""), pii_spans(t or "")
        entities = {(k, t[a:b]) for a, k, b in spans}
        df.update({w for _, _, w in words})
        held.update(entities)
        for pair in ((x, w) for x in entities for w in {w for _, _, w in free}):
            both[pair] += 1
            from_source.setdefault(pair, set()).add(sources[t])
        seen.append((entities, free))

    def tells(entity, term):
        p, k = held[entity] / len(texts), len(from_source[entity, term]) - 1
        n, z = k + df[term] - both[entity, term], pii.Z
        if p == 1 or not k:
            return False
        low = (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return low >= pii.CERTAINTY and math.log2(low / p) / math.log2(1 / p) >= disclosure

    return {i: {(s, e) for s, e, w in free if any(tells(x, w) for x in entities)} for (i, _), (entities, free) in zip(texts, seen)}


def test_pii_terms(spark):
    rng = random.Random(3)
    common = ["the", "of", "saw", "met", "wrote", "today", "é😀", "and"]
    people = [("Zed", "Quill", "zq@mail.org"), ("Ann", "Poe", "+1 (555) 010-9999"), ("Bo", "Lee", "10.0.0.1")]
    texts = []
    for i in range(600):
        w = [rng.choice(common) for _ in range(15)]
        if i % 20 == 0:
            a, b, e = people[i // 20 % 3]
            w[rng.randrange(4, 9) : 9] = [a, b, "at", e]
        texts.append((i, " ".join(w)))
    texts += [(1000, None), (1001, "")]
    rows = {r["doc_id"]: r for r in pii.scan_personal_data(docs_of(spark, texts)).collect()}
    want = brute_terms(texts)
    assert {i: {(s["start"], s["end"]) for s in r["found"] if s["kind"] == "term"} for i, r in rows.items()} == want
    assert sum(map(len, want.values())) >= 20
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(spark, texts)).collect()}
    assert not any(re.search("Quill|Poe|Lee|@|555|10.0", t or "") for t in clean.values())
    assert clean[1000] is None and clean[1001] == "" and clean[1] == dict(texts)[1]
    assert pii.scan_personal_data(docs_of(spark, [])).count() == 0 and pii.sanitise(docs_of(spark, [])).columns == docs_of(spark, []).columns
    odd = pii.scan_personal_data(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r["spans"] == "" for r in odd)


def letters(rng, n):
    """Words that many texts have."""
    return [f"{a}{b}word" for a, b in zip(rng.choices("abcdefgh", k=n), rng.choices("klmno", k=n))]


def terms_of(spark, texts):
    rows = pii.scan_personal_data(docs_of(spark, texts)).collect()
    found = {r["doc_id"]: {(s["start"], s["end"]) for s in r["found"] if s["kind"] == "term"} for r in rows}
    assert found == brute_terms(texts)
    return [[dict(texts)[i][a:b] for a, b in sorted(found[i])] for i, _ in texts]


def test_pii_terms_of_copies_and_shared_passages(spark):
    """Copies are one source, whatever their number."""
    rng = random.Random(9)
    text = lambda *inner: " ".join([*letters(rng, 9), *inner, *letters(rng, 9), "contact at"])
    copied = [text("Zork", "zq@mail.org") for _ in range(10)]
    texts = [*(20 * copied), *(20 * [text("Only", "only@mail.org")])]
    texts += [text() + " contact Bo Quill at bq@mail.org" for _ in range(30)] + [text() for _ in range(7000)]
    assert terms_of(spark, list(enumerate(texts))) == 200 * [["Zork"]] + 20 * [[]] + 30 * [["Bo", "Quill"]] + 7000 * [[]]


def test_pii_terms_of_near_copies(spark):
    """Hundreds of near copies of a text are one source, so their rare words stay."""
    rng = random.Random(12)
    base = [f"rare{k}" for k in range(150)]
    near = []
    for _ in range(300):
        w = list(base)
        for at in rng.sample(range(150), 4):
            w[at] = rng.choice(letters(rng, 1))
        near.append(" ".join([*w[:70], "near@mail.org", *w[70:]]))
    texts = [*near, *(" ".join(letters(rng, 20)) for _ in range(9000))]
    assert terms_of(spark, list(enumerate(texts))) == len(texts) * [[]]
    assert len({s for t, s in brute_sources(near).items()}) == 1


def test_pii_terms_need_evidence(spark):
    """What one text, or two, say of an entity is no evidence; three sources are, unless as many texts hold the term alone."""
    rng = random.Random(11)
    texts = [" ".join([*letters(rng, 6), f"Name{i}", *letters(rng, 6), f"mail{i}@host.org", "or", f"10.0.0.{i}", *letters(rng, 6)]) for i in range(40)]
    texts += [" ".join([*letters(rng, 15), "Twice", "two@host.org"]) for _ in range(2)]
    texts += [" ".join([*letters(rng, 15), "Thrice", "Known", "three@host.org"]) for _ in range(3)]
    texts += [" ".join([*letters(rng, 15), "known"]) for _ in range(3)]
    # an address that a third of all texts hold: a word seen with it tells little of it
    texts += [" ".join([*letters(rng, 10), f"unique{i % 50}", "all@host.org"]) for i in range(220)]
    texts += [" ".join(letters(rng, 20)) for _ in range(400)]
    assert terms_of(spark, list(enumerate(texts))) == 42 * [[]] + 3 * [["Thrice"]] + 623 * [[]]
    clean = [r["text"] for r in pii.sanitise(docs_of(spark, list(enumerate(texts)))).collect()]
    assert not any(re.search("Thrice|@|10.0.0", t) for t in clean) and sum("unique" in t for t in clean) == 220


def test_pii_planted_terms_and_unrelated_rare_words(spark):
    """Both sides: of terms planted in three to six texts of an entity 95 % go, of the others' rare words under 1 %."""
    rng = random.Random(13)
    # Zipf-like words: many are seen once or a few times
    vocabulary = [f"v{k}" for k in range(60_000)]
    weights = [1 / (k + 5) for k in range(60_000)]
    planted, texts = [], []
    for e in range(40):
        for _ in range(3 + e % 4):
            w = rng.choices(vocabulary, weights, k=60)
            w[rng.randrange(60)] = f"person{e}@host.org"
            w[rng.randrange(60)] = f"codename{e}"
            texts.append(" ".join(w))
            if f"codename{e}" in w and f"person{e}@host.org" in w:
                planted.append(len(texts) - 1)
    texts += [" ".join(rng.choices(vocabulary, weights, k=60)) for _ in range(3000)]
    got = terms_of(spark, list(enumerate(texts)))
    found = sum(any(w.startswith("codename") for w in got[i]) for i in planted)
    others = sum(not w.startswith("codename") for g in got for w in g)
    assert found >= 0.95 * len(planted) and others < 0.01 * 60 * len(planted)


def test_pii_terms_of_long_lists_of_entities(spark):
    people = [f"person{i} p{i}@host.org" for i in range(300)]
    rng = random.Random(14)
    lists = [rng.sample(people, 290) for _ in range(4)]
    texts = [*(" ".join(x) for x in lists), *(["words that all the others have"] * 900)]
    got = terms_of(spark, list(enumerate(texts)))
    assert all(len(g) > 250 for g in got[:4]) and not any(got[4:])


def test_pii_terms_anywhere_in_the_text(spark):
    rng = random.Random(10)
    texts = [" ".join(["Mira", *letters(rng, 12), "é", "mm@mail.org", *letters(rng, 12), "mira", *letters(rng, 3), "Mira"]) for _ in range(12)]
    texts += [" ".join([*letters(rng, 20), "é"]) for _ in range(1200)]
    assert terms_of(spark, list(enumerate(texts))) == 12 * [["Mira", "mira", "Mira"]] + 1200 * [[]]
    clean = pii.sanitise(docs_of(spark, list(enumerate(texts)))).select("text").collect()
    assert not any(re.search("mira|@", r["text"].lower()) for r in clean)


@pytest.mark.parametrize("blocks", [(16384, 8192), (3, 7)])
def test_topk(spark, blocks):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 40)]) for i in range(120)]
    vectors += [(200 + i, vectors[0][1]) for i in range(30)]  # ties
    odd = [(400, None), (401, [1.0, None] + [0.0] * 38), (402, [float("nan")] + [0.0] * 39), (403, []), (None, vectors[1][1]), (404, [1.0])]
    table = spark.createDataFrame([(a, b, 1, 2.0) for a, b in vectors + odd], "vec_id long, embedding array<float>, label int, score double")
    got = {}
    for r in topk.top_k(table, k=20, every=20, query_block=blocks[0], candidate_block=blocks[1]).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    e = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = {q: dict(enumerate(sorted(((i, int(e[q] @ e[i])) for i in e if i != q), key=lambda x: (-x[1], x[0]))[:20], 1)) for q in e if q % 20 == 0}
    assert got == want
    assert topk.top_k(table.limit(0)).count() == 0
    few = topk.top_k(table.where("vec_id < 4"), k=20).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]


def test_topk_of_repeated_ids_and_many_blocks(spark):
    rng = np.random.default_rng(7)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(90)]
    again = [(i, [x + 1.0 for x in v]) for i, v in vectors[:40]]  # greater vectors of the same ids
    table = spark.createDataFrame([*vectors, *again, *vectors[:10]], "vec_id long, embedding array<float>")
    least = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = {(q, r, i, s) for q in range(0, 90, 20) for r, (i, s) in enumerate(sorted(((i, int(least[q] @ least[i])) for i in least if i != q), key=lambda x: (-x[1], x[0]))[:20], 1)}
    assert {tuple(r) for r in topk.top_k(table, query_block=2, candidate_block=5).collect()} == want


def test_topk_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 8 if i % 3 else 5)]) for i in range(60)]
    odd = [(100, [float("nan")] * 9), (None, [0.5] * 12), (101, [0.5, None] * 7)]
    table = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<float>")
    e = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = {(q, r, i, s) for q in e if q % 10 == 0 for r, (i, s) in enumerate(sorted(((i, int(e[q] @ e[i])) for i in e if i != q and len(e[i]) == len(e[q])), key=lambda x: (-x[1], x[0]))[:4], 1)}
    assert {tuple(r) for r in topk.top_k(table, k=4, every=10).collect()} == want and len(want) == 24


def test_topk_of_large_components(spark):
    ids = np.arange(60)
    big = np.random.default_rng(1).integers(-(1 << 27), 1 << 27, (60, 33)).astype(float)
    q, c, s = topk.search(ids[:3], big[:3], ids, big, 5)
    for k in range(3):
        exact = sorted(((-sum(int(a) * int(b) for a, b in zip(big[k], big[i])), int(i)) for i in ids if i != k))[:5]
        assert sorted(zip((-s[q == k]).tolist(), c[q == k].tolist())) == exact


def test_warc(spark, tmp_path):
    long = "<p>é</p>" * 300
    pages = [(1, "http://a/é\r\n", long), (2, None, long), (3, "http://c", "x"), (4, "u", "x"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", long[:-1])]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string")
    rows = {r["page_id"]: r for r in warc.archive_round_trip(table).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in rows.items() if r["record_type"] == "revisit"} == {1: ("revisit", 2), None: ("revisit", 2)}
    path = str(tmp_path / "w")
    warc.write_warc(table.repartition(3), path)
    read = warc.read_warc(spark, path)
    assert {r["page_id"]: r["payload"] for r in read.where("record_type = 'response'").collect()} == {i: (h or "").encode() for i, _, h in pages if i not in (1, None)}
    assert read.where("page_id IN (3, 4)").count() == 2 and read.where("target_uri = 'http://c'").first()["page_id"] == 3
    assert warc.read_warc(spark, path, "skip").where("refers_to IS NOT NULL").count() == 2
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = lambda *ids: spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in ids], "page_id long, url string, html string")
    ids = lambda: sorted(r[0] for r in warc.read_warc(spark, path).select("page_id").collect())
    warc.write_warc(pages(1, 2), path)
    warc.write_warc(pages(3), path)
    assert ids() == [1, 2, 3]
    warc.write_warc(pages(7, 8), path, "overwrite")
    assert ids() == [7, 8] and len(list((tmp_path / "w").glob("*.warc.gz"))) <= 2


def test_warc_pushes_filters_down(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([(1, "http://x", "p" * 2000), (2, "http://y", "p" * 2000)], "page_id long, url string, html string"), path)
    wanted = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert not re.search(r"\bFilter \(", wanted._jdf.queryExecution().executedPlan().toString()) and [r["page_id"] for r in wanted.collect()] == [1]


def test_warc_of_other_writers(spark, tmp_path):
    def record(kind, uri, head, body):
        block = (f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() if head else b"") + body
        named = "Content-Type: application/http; msgtype=response\r\n" if head else ""
        top = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Date: 2020-01-0{uri}T00:00:00Z\r\n{named}Content-Length: {len(block)}\r\n\r\n"
        return top.encode() + block + b"\r\n\r\n"

    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    (tmp_path / "f.warc").write_bytes(
        record("warcinfo", 1, "", b"software: x") + record("response", 2, "Transfer-Encoding: chunked\r\nContent-Encoding: GZIP", chunked)
        + record("response", 3, "transfer-encoding: chunked", b"no chunks") + record("response", 4, "Content-Length: 3", b"abc")
    )
    rows = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert {i: (r["record_type"], r["payload"], r["content_encoding"], r["page_id"]) for i, r in rows.items()} == {
        "urn:uuid:1": ("warcinfo", b"software: x", None, None), "urn:uuid:2": ("response", b"hello world", "gzip", None),
        "urn:uuid:3": ("response", b"no chunks", None, None), "urn:uuid:4": ("response", b"abc", None, None),
    }
    assert rows["urn:uuid:2"]["date"] == "2020-01-02T00:00:00Z" and rows["urn:uuid:2"]["payload_bytes"] == 11


def test_warc_skips_by_length_and_splits(tmp_path):
    records = [warc.warc_record(i, f"http://x/{i}", bytes([65 + i]) * 5000, "response", None, "00" * 20, "d") for i in range(20)]
    packed = tmp_path / "a.warc.gz"
    packed.write_bytes(b"".join(map(warc.gzip_member, records)))
    plain = tmp_path / "a.warc"
    plain.write_bytes(b"".join(records))
    import gzip

    foreign = tmp_path / "b.warc.gz"
    foreign.write_bytes(b"".join(map(gzip.compress, records)))
    for path in (packed, plain, foreign):
        size, gz = path.stat().st_size, path.suffix == ".gz"
        with path.open("rb") as f:
            for cuts in ([0, size], [0, size // 3, size // 2, size] if gz else [0, size]):
                got = [r for a, b in zip(cuts, cuts[1:]) for r in warc.scan(f, a, b, lambda r: r["page_id"] % 2 == 0, "bytes", gz)]
                assert [(r["page_id"], r["payload"]) for r in got] == [(i, bytes([65 + i]) * 5000) for i in range(0, 20, 2)]


def foreign(i, body, eol="\r\n", length=None, kind="response"):
    block = f"HTTP/1.1 200 OK{eol}Content-Type: text/html{eol}{eol}".encode() + body
    top = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", "Content-Type: application/http; msgtype=response"]
    top.append(f"Content-Length: {len(block) if length is None else length}")
    return eol.join([*top, "", ""]).encode() + block + 2 * eol.encode()


def read_back(spark, folder, **options):
    rows = warc.read_warc(spark, str(folder), **options).collect()
    return sorted(((r["record_id"] or "").removeprefix("urn:uuid:"), r["payload"], r["error"]) for r in rows)


@pytest.mark.parametrize("eol", ["\r\n", "\n"])
def test_warc_members_of_many_records_and_either_line_end(spark, tmp_path, eol):
    """Records inside one gzip member, in several and in a plain file, with bodies that hold empty lines."""
    import gzip

    bodies = [b"first\n\nbody", b"", b"x" * 200_000 + b"\r\n\r\nWARC/", b"last"]
    records = [foreign(i, b, eol) for i, b in enumerate(bodies)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[:3])) + bytes(7) + gzip.compress(records[3]))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "c.warc").write_bytes(b"".join(records))
    want = [(str(i), b, None) for i, b in enumerate(bodies)]
    for folder in ("one", "two", "plain"):
        assert read_back(spark, tmp_path / folder) == want
        assert [r[0] for r in read_back(spark, tmp_path / folder, payload="skip")] == [r[0] for r in want]


def test_warc_records_without_a_length(spark, tmp_path):
    """Reading goes on at the next record, and what was passed over is told."""
    import gzip

    records = [foreign(1, b"one"), foreign(2, b"two", length="x"), foreign(3, b"three"), b"junk\r\n\r\n", foreign(4, b"four"), foreign(5, b"five", length="-3")]
    want = [("", None, "37 bytes that are no record"), ("", None, "38 bytes that are no record"), ("", None, "4 bytes that are no record"),
            ("1", b"one", None), ("2", None, "no length but 'x'"), ("3", b"three", None), ("4", b"four", None), ("5", None, "no length but '-3'")]
    for name, data in (("a.warc", b"".join(records)), ("b.warc.gz", gzip.compress(b"".join(records)))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(data)
        got = read_back(spark, folder)
        assert [(i, p, re.sub(r"\d+ bytes", "n bytes", e or "")) for i, p, e in got] == [(i, p, re.sub(r"\d+ bytes", "n bytes", e or "")) for i, p, e in want]
        assert warc.read_warc(spark, str(folder)).where("record_type = 'response'").count() == 5


def test_warc_records_that_are_cut_off(spark, tmp_path):
    """A payload comes as far as it goes, without a digest and with an error; damage stops nothing but its member."""
    import gzip

    body = bytes(random.Random(5).choices(range(256), k=5000))
    whole, cut = foreign(1, b"whole"), foreign(2, body)
    packed = gzip.compress(cut)
    damaged = bytearray(packed)
    damaged[2500:2600] = bytes(100)
    files = {
        "plain": ("a.warc", whole + cut[: len(cut) - 3004]), "gzip": ("b.warc.gz", gzip.compress(whole) + packed[:2600]),
        "own": ("c.warc.gz", warc.gzip_member(whole) + warc.gzip_member(cut)[:2600]), "damaged": ("d.warc.gz", bytes(damaged) + gzip.compress(whole)),
        "headers": ("e.warc", whole + b"WARC/1.0\r\nWARC-Type: resp"), "empty": ("f.warc", b""), "newlines": ("g.warc", b"\r\n\r\n"),
    }
    for name, (file, data) in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_bytes(data)
    for name in ("plain", "gzip", "own", "damaged"):
        rows = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / name)).collect()}
        one, two = rows["urn:uuid:1"], rows["urn:uuid:2"]
        assert (one["payload"], one["error"]) == (b"whole", None)
        assert two["payload_digest"] is None and re.fullmatch(r"cut off: \d+ bytes are missing", two["error"])
        # what is damaged may decode to something else before that shows
        assert body.startswith(two["payload"] if name != "damaged" else two["payload"][:1000]) and len(two["payload"]) == two["payload_bytes"] < 5000
    assert next(r["payload_bytes"] for r in warc.read_warc(spark, str(tmp_path / "plain")).collect() if r["error"]) == 2000
    skipped = warc.read_warc(spark, str(tmp_path / "plain"), "skip").where("error IS NOT NULL").collect()
    assert [r["error"] for r in skipped] == ["cut off: 3000 bytes are missing"]
    assert [r["error"] is None for r in warc.read_warc(spark, str(tmp_path / "own"), "skip").orderBy("record_id").collect()] == [True, False]
    assert read_back(spark, tmp_path / "headers") == [("", None, "headers without an end"), ("1", b"whole", None)]
    assert read_back(spark, tmp_path / "empty") == [] == read_back(spark, tmp_path / "newlines")


def test_warc_of_a_very_long_payload(spark, tmp_path):
    long = "x" * 9_000_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "v", "short")], "page_id long, url string, html string")
    rows = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"], r["error"]) for r in warc.archive_round_trip(pages).collect()}
    assert rows == {1: (9_000_000, "revisit", 2, None), 2: (9_000_000, "response", None, None), 3: (5, "response", None, None)}


def test_queries_match_their_oracles(spark):
    import duckdb

    from tests.test_catalogue import TABLES, rows_of

    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF), c.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall()), name
    for name in set(queries.queries()) - set(queries.oracle_sql()):
        assert queries.queries()[name](spark, SF).count() > 0


def test_stages_keep_columns_of_any_name(spark):
    docs = docs_of(spark, [*ODD, (7, "Write to me@host.org now"), (8, "a b c d e f g"), (9, "a b c d e f g")])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nobody has these words")], "item_id long, text string")
    for out in (toxicity.drop_toxic(docs, labels), jaccard.drop_near_duplicates(docs), decontaminate.drop_leaks(docs, bench), pii.sanitise(docs)):
        assert out.columns == docs.columns and out.schema == docs.schema
        assert all(tuple(r)[2:] == tuple(CLASHING) for r in out.collect())
    scored = toxicity.score_texts(docs, toxicity.train(docs, labels))
    assert sorted(scored.columns) == sorted({*docs.columns, "score", "n_sentences", "offending"})


def test_checkpoints_leave_no_shuffles_on(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    assert cluster.checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert spark.conf.get(key) == before
