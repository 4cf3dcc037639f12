"""The subpackage's queries over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    kept = remove_repeats(_table(spark, sf_dir, "documents"), window=35, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


_OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), k AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r
), p AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w
), a AS (
  SELECT p.doc_id, count(g.p) AS n_removed,
         string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY p.p) AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


_OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import tokenize

    out = tokenize(_table(spark, sf_dir, "documents"), tokenizer_path(), with_tokens=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    scored = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    """The votes in SQL, over the words themselves instead of their hashes."""
    from .licenses import BASE, COVERAGE, DRIFT, STRETCH, TEMPLATES, template_words

    listed = [(label, phrase, True) for phrase, label in BASE.items()] + [(a, b, False) for a, b in TEMPLATES]
    values = ", ".join(f"({n}, '{label}', {base}, string_split('{' '.join(template_words(text))}', ' '))" for n, (label, text, base) in enumerate(listed))
    covered = "CAST(count(DISTINCT off) AS DOUBLE) / grams"
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), t AS (SELECT *, least(3, len(ws)) AS size FROM (VALUES {values}) x(template, label, base, ws)
), o AS (SELECT template, label, base, size, ws, len(ws) AS length, len(ws) - size + 1 AS grams, unnest(range(0, len(ws) - size + 1)) AS off FROM t
), k AS (SELECT template, label, base, size, length, grams, off, array_to_string(ws[off + 1:off + size], ' ') AS gram FROM o
), g AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w
), h AS (SELECT doc_id, i - 1 AS place, array_to_string(words[i:i + 2], ' ') AS gram FROM g WHERE i + 2 <= len(words)
  UNION ALL SELECT doc_id, i - 1, array_to_string(words[i:i + 1], ' ') FROM g WHERE i + 1 <= len(words)
), v AS (SELECT doc_id, template, label, base, size, length, grams, off, place, place - off AS diag FROM h JOIN k USING (gram)
), d AS (SELECT DISTINCT doc_id, template, base, diag FROM v
), r AS (SELECT *, CASE WHEN base OR coalesce(diag - lag(diag) OVER (PARTITION BY doc_id, template ORDER BY diag) > {DRIFT}, true) THEN 1 ELSE 0 END AS brk FROM d
), q AS (SELECT doc_id, template, diag, sum(brk) OVER (PARTITION BY doc_id, template ORDER BY diag) AS run FROM r
), f AS (SELECT doc_id, label, base, {covered} AS covered, min(place) AS start FROM v JOIN q USING (doc_id, template, diag)
  GROUP BY doc_id, template, label, base, length, grams, run
  HAVING CASE WHEN base THEN count(DISTINCT off) = grams ELSE {covered} >= {COVERAGE} AND max(place + size) - min(place) <= {STRETCH} * length END)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, count(start) FILTER (base) AS n_base,
       min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered), 0.0) AS score
FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id, words
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _op7_sql() -> str:
    """All rules on all texts, without an index; places by counting off what lies between."""
    from .secrets import BASE, ISSUED

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for number, rule in enumerate(BASE + ISSUED):
        # a run of hexadecimal digits is long enough or holds nothing that is
        p = quoted("[0-9a-f]{24,}" if rule.kind == "hex" else rule.pattern)
        parts.append(
            f"SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, {p}) AS gaps, "
            f"regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {rule.group}) AS parts FROM d"
        )
    lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: length(t))), 0)"
    span = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)})
, k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0)
, p AS (SELECT doc_id, number, kind, CAST({lengths("gaps[1:i]")} + {lengths("hits[1:i - 1]")} AS BIGINT) AS start, length(hits[i]) AS n
  FROM k WHERE length(parts[i]) >= least)
, s AS (SELECT *, start + n AS stop FROM p)
SELECT d.doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
       sha256(coalesce(string_agg({span}, ',' ORDER BY start, number) FILTER (number < 3), '')) AS base_sha256,
       coalesce(string_agg({span}, ',' ORDER BY start, number) FILTER (number IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), size=5, percent=75)


_OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), s AS (
  SELECT g.doc_id, g.h FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id
  WHERE 100 * o >= 75 * (x.n + y.n - o)
), r AS (
  SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e
), reach AS (
  SELECT x, y FROM r UNION SELECT reach.x, r.y FROM reach JOIN r ON reach.y = r.x
), least AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.x
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan_personal_data

    return scan_personal_data(_table(spark, sf_dir, "documents")).drop("found")


def _op9_sql() -> str:
    """Forms by regular expressions, terms by plain counts; places by counting off what lies between."""
    from .pii import CERTAINTY, DISCLOSURE, KINDS, MARKS, SHINGLE, SPREAD, TERM, Z

    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    odd = "CAST(substr(reverse(digits), i, 1) AS INTEGER) * (2 - i % 2)"
    checks = [
        "true",
        "len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INTEGER) > 255)) = 0",
        f"length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: {odd} - CASE WHEN {odd} > 9 THEN 9 ELSE 0 END)) % 10 = 0",
        "length(digits) BETWEEN 9 AND 15",
    ]
    cut = lambda text, p: f"unnest(string_split_regex({text}, '{p}')) AS gap, unnest(regexp_extract_all({text}, '{p}', 0)) AS hit, unnest(range(len(string_split_regex({text}, '{p}')))) AS i"
    forms = " UNION ALL ".join(f"SELECT doc_id, {k} AS number, '{kind}' AS kind, {cut('text', p)} FROM d" for k, (kind, p) in enumerate(zip(KINDS, patterns, strict=True)))
    placed = "sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id{} ORDER BY i)"
    valid = " OR ".join(f"(number = {k} AND ({c}))" for k, c in enumerate(checks))
    span = "kind || ':' || start || ':' || stop"
    step = """, s{k} AS (SELECT key, min(least) AS source FROM m{j} JOIN (SELECT mark, min(source) AS least FROM m{j} GROUP BY mark) USING (mark) GROUP BY key)
, m{k} AS (SELECT m{j}.key, mark, s{k}.source FROM m{j} JOIN s{k} USING (key))"""
    spread = "".join(step.format(k=k, j=k - 1) for k in range(1, SPREAD + 1))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({forms}
), p AS (SELECT *, {digits} AS digits, CAST({placed.format(", number")} AS BIGINT) AS stop FROM m
), b AS (SELECT doc_id, number, kind, hit, stop - length(hit) AS start, stop FROM p WHERE hit IS NOT NULL AND ({valid})
), l AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d
), v AS (SELECT doc_id, {cut("low", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} FROM l
), w AS (SELECT doc_id, hit AS word, stop - length(hit) AS start, stop FROM (SELECT *, CAST({placed.format("")} AS BIGINT) AS stop FROM v) WHERE hit IS NOT NULL
), f AS (SELECT * FROM w WHERE doc_id IN (SELECT doc_id FROM b)
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND w.start < b.stop AND w.stop > b.start)
), dt AS (SELECT word, count(DISTINCT doc_id) AS df FROM w GROUP BY word
), e AS (SELECT DISTINCT doc_id, number, hit FROM b), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d
), de AS (SELECT number, hit, count(*) / n AS pe FROM e, nn GROUP BY number, hit, n HAVING count(*) < n
), x AS (SELECT CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS key, min(doc_id) AS doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM b) GROUP BY text
), xw AS (SELECT key, list(word ORDER BY start) FILTER (word IS NOT NULL) AS ws FROM x LEFT JOIN f USING (doc_id) GROUP BY key
), sh AS (SELECT key, coalesce(array_to_string(ws[i:i + {SHINGLE - 1}], ' '), '') AS s
  FROM (SELECT key, ws, unnest(range(1, greatest(2, coalesce(len(ws), 0) - {SHINGLE - 2}))) AS i FROM xw)
), hs AS (SELECT key, own, sha256(own || s) AS h FROM sh, (SELECT unnest(range(2)) AS own)
), m0 AS (SELECT key, (4 * own + k) || min(substr(h, 16 * k + 1, 8)) || min(substr(h, 16 * k + 9, 8)) AS mark, key AS source
  FROM hs, (SELECT unnest(range({MARKS // 2})) AS k) GROUP BY key, own, k
){spread}
, co AS (SELECT number, hit, word, count(*) AS n_both, count(DISTINCT source) AS co
  FROM e JOIN (SELECT DISTINCT doc_id, word FROM f) USING (doc_id) JOIN d USING (doc_id)
  JOIN (SELECT DISTINCT key, source FROM m{SPREAD}) y ON y.key = CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) GROUP BY number, hit, word
), tr AS (SELECT number, hit, word, pe, CAST(co - 1 AS DOUBLE) AS k, CAST(co - 1 + df - n_both AS DOUBLE) AS n FROM co JOIN de USING (number, hit) JOIN dt USING (word) WHERE co > 1
), lo AS (SELECT *, (k / n + {Z * Z} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n) AS low FROM tr
), t AS (SELECT number, hit, word FROM lo WHERE low >= {CERTAINTY} AND log2(low / pe) / log2(1 / pe) >= {DISCLOSURE}
), s AS (SELECT doc_id, number, kind, start, stop FROM b
  UNION ALL SELECT DISTINCT f.doc_id, {len(KINDS)}, '{TERM}', start, stop FROM f JOIN e USING (doc_id) JOIN t ON e.number = t.number AND e.hit = t.hit AND f.word = t.word)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (number = {k}) AS n_{kind}" for k, kind in enumerate(KINDS))},
       sha256(coalesce(string_agg({span}, ',' ORDER BY start, number) FILTER (number < {len(KINDS)}), '')) AS base_sha256,
       coalesce(string_agg({span}, ',' ORDER BY start, number) FILTER (number IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    archived = archive_round_trip(_table(spark, sf_dir, "pages"))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), m AS (
  SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"), unit="line", seed="7", rate=100, spm=50)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
), g AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS x FROM d
), c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
              WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import classify_languages

    told = classify_languages(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "held_out", F.col("nearest").alias("lang_pred"), "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_repeats": op2_repeats,
        "op3_topk": op3_topk,
        "op4_bpe": op4_bpe,
        "op5_toxicity": op5_toxicity,
        "op6_licenses": op6_licenses,
        "op7_secrets": op7_secrets,
        "op8_jaccard": op8_jaccard,
        "op9_pii": op9_pii,
        "op10_warc": op10_warc,
        "op11_alignment": op11_alignment,
        "op12_fim": op12_fim,
        "op13_langid": op13_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_repeats": _OP2_SQL,
        "op3_topk": _OP3_SQL,
        "op6_licenses": _op6_sql(),
        "op7_secrets": _op7_sql(),
        "op8_jaccard": _OP8_SQL,
        "op9_pii": _op9_sql(),
        "op10_warc": _OP10_SQL,
        "op12_fim": _OP12_SQL,
    }
