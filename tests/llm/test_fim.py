"""Fill-in-the-middle against regular expressions and round trips."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserix.llm import fim, queries
from tests.llm.test_operators import ODD, docs_of

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s)."}


def parts_of(text, unit):
    """Units; those of words begin at a word that white space precedes, so what stands before the first word is one by itself."""
    if unit != "word":
        return re.findall(PATTERNS[unit], text)
    starts = sorted({0, *(m.start() for m in re.finditer(r"(?<=[\x20\x09-\x0d])[^\x20\x09-\x0d]", text))})
    return [] if not text else [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def plainly(doc_id, text, unit="line", seed="7", rate=100, spm=50):
    text, digest = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = parts_of(text, unit)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def made(rows):
    return [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows]


def texts(seed, n=300):
    rng = random.Random(seed)
    letters = ["\n", "\n\n", "\r\n", " ", "a", "é", "😀", "<", ">", "P", "S", "<P", "S>", "\x0b", " ", "word "]
    out = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for k in range(n)]
    return [*out, (n, "x<M>y"), (n + 1, "\n"), (n + 2, "line\n" * 30_000 + "é"), (n + 3, "é" * 100_000)]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 20)])
def test_forms_outputs_and_what_is_restored(spark, unit, rate, spm):
    rows = [*texts(3), *ODD]
    out = fim.fill_in_middle(docs_of(spark, rows).repartition(3), unit=unit, seed="7", rate=rate, spm=spm)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(made(got), key=key) == sorted((plainly(i, t, unit, "7", rate, spm) for i, t in rows), key=key)
    assert all(r["back"] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_marks_and_seeds(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = [(k, f"one {k}\ntwo <P> \nthree\n") for k in range(40)]
    out = fim.fill_in_middle(docs_of(spark, rows), seed="other", marks=marks)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == r["text"] and r["form"] != "plain" for r in got)
    assert len({r["prefix_chars"] for r in got}) > 2


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 16])
@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_chunks_of_any_size_give_the_same_cuts(chunk, unit):
    rows = [t for _, t in texts(5, 60)][:-2]
    own = fim.Chunks(pa.array([*rows, None, ""]), fim.UNITS[unit], chunk)
    for k, text in enumerate([*rows, "", ""]):
        units = parts_of(text, unit)
        assert own.n_units[k] == len(units)
        assert [own.cut(k, r) for r in range(len(units) + 2)] == [*(len("".join(units[:r])) for r in range(len(units) + 1)), len(text)]


def test_chunks_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 50)
    rows = [t for _, t in texts(6, 60)][:-2]
    own = fim.Chunks(pa.array(rows), fim.UNITS["line"], 9)
    assert own.n_units.tolist() == [len(parts_of(t, "line")) for t in rows]


def test_no_rows(spark):
    assert fim.fill_in_middle(docs_of(spark, [])).count() == 0
    assert "op12_fim" in queries.oracle_sql()
