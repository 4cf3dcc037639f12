"""Alignment of two tokenizers against both libraries, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tesserix.llm import alignment, bpe, queries
from tests.conftest import SF
from tests.llm.test_operators import ODD, docs_of

PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The contract in plain Python: whole texts through both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(queries.tokenizer_path(PATHS[0]))
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(PATHS[1]))
    symbols = bpe._byte_symbols()

    def bytes_b(i):
        piece = side_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if side_b.is_byte(i) else piece.replace("▁", " ").encode()

    def run(rows):
        counts, aligned = Counter(), []
        for i, text in rows:
            raw = (" " + (text or "")).encode()
            a, b = side_a.encode(" " + (text or ""), add_special_tokens=False).ids, side_b.encode(text or "")
            parts = [[bytes(symbols[c] for c in side_a.id_to_token(x)) for x in a], [bytes_b(x) for x in b]]
            if not text or any(b"".join(p) != raw for p in parts):
                aligned.append((i, 0, 0, 0, [], ""))
                continue
            ends = []
            for p in parts:
                at, own = 0, {}
                for k, x in enumerate(p):
                    at += len(x)
                    own[at] = k
                ends.append(own)
            groups, links, k, m = [], [], 0, 0
            for cut in sorted(ends[0].keys() & ends[1].keys()):
                x, y = ends[0][cut], ends[1][cut]
                groups.append(",".join(map(str, a[k : x + 1])) + "|" + ",".join(map(str, b[m : y + 1])))
                links.append((a[x], b[y]))
                k, m = x + 1, y + 1
            counts.update(links)
            aligned.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        best = defaultdict(int)
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        rows = [(i, x, y, g, len(p), sum(counts[k] == best[k[1]] for k in p), sum(counts[k] for k in p), h) for i, x, y, g, p, h in aligned]
        return Counter(rows), counts, best

    return run


def paths():
    return [queries.tokenizer_path(p) for p in PATHS]


def mixed(seed=4, n=500):
    rng = random.Random(seed)
    letters = list(" \n\t\r\x0b\x1c\x85\xa0　abXY'sellre01½Ⅷ一éñ😀́‍.,<|>▁") + ["<|endoftext|>", "<s>", "<0x41>", "the ", "token", "  ", " of"]
    weights = [8] + [1] * (len(letters) - 8) + [4] * 7
    return [(k, "".join(rng.choices(letters, weights, k=rng.randint(0, 60)))) for k in range(n)]


def test_alignment_is_that_of_both_libraries(spark, plain):
    rows = [*mixed(), *ODD, (1000, "a" * 3000), (1001, " " * 999 + "x"), (1002, "▁"), (1003, "same words here"), (1004, "same words here")]
    got = Counter(tuple(r) for r in alignment.align(docs_of(spark, rows).repartition(3), *paths()).collect())
    assert got == plain(rows)[0]


def test_alignment_of_a_table(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op11_alignment(spark, SF).collect()) == plain(docs)[0]


def test_alignment_in_many_lots_parts_and_tasks(spark, plain, monkeypatch):
    """Lots of few links, parts dealt over several tasks, counts passed on early, units forgotten."""
    for name, value in {"LOT_LINKS": 40, "LOT_DOCS": 3, "TASK_ENTRIES": (50, 50), "KEPT_UNITS": 30, "TOGETHER": 7}.items():
        monkeypatch.setattr(alignment, name, value)
    rows = [(k, f"the same line of the corpus {k % 5}") for k in range(60)] + mixed(5, 80)
    got = Counter(tuple(r) for r in alignment.align(docs_of(spark, rows).coalesce(2), *paths()).collect())
    assert got == plain(rows)[0]


def test_pair_counts(spark, plain):
    rows = mixed(6, 120)
    _, counts, best = plain(rows)
    got = {(r["a"], r["b"]): (r["links"], r["best"]) for r in alignment.pair_counts(docs_of(spark, rows), *paths()).collect()}
    assert got == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_alignment_of_no_texts(spark):
    out = alignment.align(docs_of(spark, []), *paths())
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "n_a", "n_b"]
    none = alignment.align(docs_of(spark, [(1, None), (None, "")]), *paths()).collect()
    assert Counter(tuple(r) for r in none) == Counter([(1, *[0] * 6, ""), (None, *[0] * 6, "")])


def test_task_counts_are_passed_on_in_parts(monkeypatch):
    """Sums stay right when a task tells its counts several times."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(alignment, "PAIRS_AT_A_TIME", 5)
    keys = [np.array([1, 2, 3, 70_000, 5, 6, 7, 2, 2]), np.array([9, 1, 1, 2])]
    rows = [r for k in range(6) for r in alignment._messages(f"0-{k}", [], keys, 50_257) if r["part"] is not None]
    batch = pa.RecordBatch.from_pylist(rows, alignment._FIELDS)
    total = Counter()
    for out in alignment._task_counts([batch, batch]):
        for pair, links in zip(*(c.to_pylist() for c in out.columns), strict=True):
            total[pair] += links
    assert total == {k: 12 * n for k, n in Counter(np.concatenate(keys).tolist()).items()}
