"""Personal data: base patterns and information-theoretic sanitisation of what surrounds them.

E-mail addresses, IP addresses, card and telephone numbers are found by their forms.  Each
distinct one is a protected entity.  How much a term tells of it follows from corpus counts.  One text
that holds both is no evidence, as every word of it does so: what counts is whether the texts with
the term that are known from elsewhere hold the entity too.  With co(e, t) the sources of the texts that
hold the entity and the term, and rest(e, t) the texts that hold the term alone, p(e | t) is
estimated from k = co - 1 of n = co - 1 + rest, one source being the one at hand, and taken at the
lower end of Wilson's interval of ``Z`` standard errors.  With df(e) of all N texts and p(e) = df(e) / N
the term discloses the share

    log2(p(e | t) / p(e)) / log2(1 / p(e))

of the entity's information.  Terms over a threshold, and whose p(e | t) is ``CERTAINTY`` or more, are
removed wherever they stand in a text that holds their entity, and entities are generalised to their
kind.  So a term in three sources with an entity and nowhere else tells of it, and one in two doesn't.

A source is a text and its near copies.  Texts that hold entities have ``MARKS`` marks, two min-hashes
each, of the five-word shingles of what else they say; a text takes the least number of the texts with
which it shares a mark, ``SPREAD`` times over.  So 99.9 % of pairs of a similarity of 0.75 are one source.  df(e), rest and N count all texts, copies included.

One pass finds entities and counts each task's words; what follows joins the words of texts that
hold entities.  Entities that stand in just the same texts share all their counts and are one class,
so a text's terms meet its classes and not each of a long list of entities.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .cluster import binary_column, checkpointed, flat_binary, row_slices, salted_join, tidy, whole_rows
from .words import LOWER, NOT_ALNUM, Words, distinct, slices

#: Kinds in the order they are listed; terms follow them.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information, and least chance of it, from which on a term is removed.
DISCLOSURE, CERTAINTY = 0.7, 0.25
#: Standard errors of the lower bound: 2.5 % of true chances are below it.
Z = 1.96
#: Words of a shingle, marks of a text, rounds in which texts that share one become one source.
SHINGLE, MARKS, SPREAD = 5, 8, 3
#: Words in more than this share of the texts are told by a broadcast: a hundred times as many as
#: a text's different words at most.
FREQUENT = 0.01
#: Distinct words that a task counts before it passes the counts on.
WORDS_AT_A_TIME = 1 << 21

# the base patterns; the look-behinds only save starts that would fail or be taken
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str):
    """Leftmost matches, found from each @ outwards so that long texts take linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def text_key(text: str) -> int:
    """A text's number: 15 digits of its MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def marks_of(words: list[bytes]) -> list[str]:
    """Two min-hashes of the shingles each, and their place: a shingle's SHA-256, with 0 or 1 before it,
    is eight hashes of eight digits."""
    shingles = {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    least = [np.frombuffer(b"".join(hashlib.sha256(own + s).digest() for s in shingles), ">u4").reshape(-1, 8).min(axis=0) for own in (b"0", b"1")]
    pairs = np.concatenate(least).reshape(MARKS, 2).tolist()
    return [f"{k}{a:08x}{b:08x}" for k, (a, b) in enumerate(pairs)]


_SPAN = "struct<start:bigint,number:int,kind:string,end:bigint>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
#: Of what a scan adds to each row.
_SCANNED = {
    "base": (_SPANS, f"array<{_SPAN}>"), "base_sha256": (pa.string(), "string"), "entities": (pa.list_(pa.int64()), "array<bigint>"),
    "key": (pa.int64(), "bigint"), "terms": (pa.list_(pa.int64()), "array<bigint>"), "held": (pa.string(), "string"),
    "marks": (pa.list_(pa.string()), "array<string>"), "words": (pa.binary(), "binary"), "counts": (pa.binary(), "binary"),
}


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def _free(words: Words, row: int, text: str, spans) -> np.ndarray:
    """The words of a text (as indices of ``words``) that are in none of the spans."""
    lo, hi = int(words.bounds[row]), int(words.bounds[row + 1])
    base = int(words.text_bounds[row])
    to_byte = (lambda k: k) if text.isascii() else (lambda k: len(text[:k].encode()))
    starts, ends = words.start[lo:hi] - base, words.end[lo:hi] - base
    free = np.ones(hi - lo, bool)
    for a, b in spans:
        free[np.searchsorted(ends, to_byte(a), "right") : np.searchsorted(starts, to_byte(b), "left")] = False
    return lo + np.flatnonzero(free)


@tidy
def _scan(batches, text_at: int | None):
    """Each row (its text is field ``text_at`` of it, or else stands beside it) with its base spans
    and entities and, if it has any, its hash, its different terms and its text (unless the row
    has it); then the task's words with the number of texts that hold each, in rows of their own."""
    names, kinds, kept_kind, seen, waiting = ["row", *_SCANNED], [k for k, _ in _SCANNED.values()], None, [], 0

    def told():
        keys = np.concatenate([k for k, _ in seen])
        values, index = np.unique(keys, return_inverse=True)
        counts = np.bincount(index, weights=np.concatenate([c for _, c in seen])).astype(np.int64)
        whole = np.array([0, len(values)])
        nothing = [pa.nulls(1, t) for t in [kept_kind, *kinds[:-2]]]
        return pa.RecordBatch.from_arrays([*nothing, binary_column(values, whole), binary_column(counts, whole)], names)

    for batch in batches:
        parts = row_slices(batch, text_at) if text_at is not None else ((x.column(0), x.column(1)) for x in slices(batch))
        for rows, column in parts:
            kept_kind = rows.type
            texts = [t or "" for t in column.to_pylist()]
            words = Words(column, separators=NOT_ALNUM, fold=LOWER)
            values, index = np.unique(words.hash, return_inverse=True)
            pairs = np.unique(words.owner() * max(1, len(values)) + index) % max(1, len(values))
            seen.append((values, np.bincount(pairs, minlength=len(values))))
            waiting += len(values)
            columns: list[list] = [[] for _ in kinds[:-2]]
            for row, text in enumerate(texts):
                spans = base_spans(text)
                listed = [{"start": a, "number": k, "kind": KINDS[k], "end": b} for a, k, b in spans]
                columns[0].append(listed)
                columns[1].append(hashlib.sha256(joined((a, k, KINDS[k], b) for a, k, b in spans).encode()).hexdigest())
                columns[2].append(sorted({_hash(KINDS[k], text[a:b]) for a, k, b in spans}))
                columns[3].append(text_key(text) if spans else None)
                free = _free(words, row, text, [(a, b) for a, _, b in spans]) if spans else None
                columns[4].append(distinct(words.hash[free]).view(np.int64) if spans else None)
                columns[5].append(text if spans and text_at is None else None)
                own = [words.folded[a:b].tobytes() for a, b in zip(words.start[free].tolist(), words.end[free].tolist(), strict=True)] if spans else []
                columns[6].append(marks_of(own) if spans else None)
            empty = pa.nulls(len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([rows, *map(pa.array, columns, kinds[:-2]), empty, empty], names)
            if waiting > WORDS_AT_A_TIME:
                yield told()
                seen, waiting = [], 0
    if seen:
        yield told()


def _unpacked(batches):
    for batch in batches:
        words, _ = flat_binary(batch.column("words"), np.int64)
        counts, _ = flat_binary(batch.column("counts"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], ["term", "n"])


@tidy
def _marked(batches, text_at: int | None):
    """Rows with the spans of their ``terms``, which tell of their entities."""
    for batch in batches:
        held = batch.column("held") if text_at is None else pc.struct_field(batch.column("row"), [text_at])
        for part in slices(batch.append_column("text", held)):
            words = Words(part.column("text"), separators=NOT_ALNUM, fold=LOWER)
            found = []
            for row, (own, spans, terms) in enumerate(zip(*(part.column(n).to_pylist() for n in ("text", "base", "terms")), strict=True)):
                free = _free(words, row, own, [(x["start"], x["end"]) for x in spans])
                free = free[np.isin(words.hash[free].view(np.int64), np.array(terms or [], np.int64))]
                base = int(words.text_bounds[row])
                raw = words.raw[base : int(words.text_bounds[row + 1])]
                upto = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                bounds = zip(upto[words.start[free] - base].tolist(), upto[words.end[free] - base].tolist(), strict=True)
                found.append([{"start": a, "number": len(KINDS), "kind": TERM, "end": b} for a, b in bounds])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in _FOUND), pa.array(found, _SPANS)], [*_FOUND, "found"])


_FOUND = ("row", "base", "base_sha256")


def _disclosed(n, df_entity, df_term, co, both, disclosure: float):
    """Whether a term discloses an entity, as a Column; ``co`` sources and ``both`` texts have both."""
    p, z = df_entity / n, F.lit(Z * Z)
    tried = co - 1 + df_term - both
    rate = (co - 1) / tried
    low = (rate + z / (2 * tried) - Z * F.sqrt(rate * (1 - rate) / tried + z / (4 * tried * tried))) / (1 + z / tried)
    return (co > 1) & (low >= CERTAINTY) & (F.log2(low / p) / F.log2(1 / p) >= disclosure)


def sources(marked: DataFrame) -> DataFrame:
    """``key, source`` of texts with their ``marks``: the least key that is reached in ``SPREAD`` steps
    between texts that share a mark."""
    at = checkpointed(marked.select("key", F.explode("marks").alias("mark"), F.col("key").alias("source")))
    for k in range(SPREAD):
        least = at.groupBy("mark").agg(F.min("source").alias("least"))
        own = salted_join(at.select("key", "mark"), least, ["mark"], "key").groupBy("key").agg(F.min("least").alias("source"))
        if k < SPREAD - 1:
            at = checkpointed(at.select("key", "mark").join(own, "key"))
    return own


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, keep: list[str] | None = None) -> DataFrame:
    """Personal data and telling terms in every text.

    Takes ``text``.  Returns a row per input row: ``row``, a struct of the columns ``keep`` (all,
    if not given; they are checkpointed with what is found), ``base`` and ``found`` (arrays of
    start, number, kind, end; code points, end exclusive; ``found`` has the terms as well) and
    ``base_sha256``.  Base kinds are matched leftmost without overlaps in their kind; matches that
    fail their check are dropped and not retried.  Texts are read whole.  A null text has nothing;
    repeated rows are texts of their own, of one source; an entity that all texts hold has no
    information that terms could disclose.
    """
    names = docs.columns if keep is None else keep
    holding, others = _assessed(docs, disclosure, names)
    text_at = names.index("text") if "text" in names else None
    added = StructType.fromDDL(f"base array<{_SPAN}>, base_sha256 string, found array<{_SPAN}>").fields
    marked = holding.mapInArrow(lambda it: _marked(it, text_at), StructType([holding.schema["row"], *added]))
    others = others.select(*_FOUND, F.array().cast(f"array<{_SPAN}>").alias("found"))
    return marked.unionAll(others).select(*_FOUND, F.array_sort(F.concat("base", "found")).alias("found"))


def _assessed(docs: DataFrame, disclosure: float, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (columns ``names``) whose texts hold entities, with the terms that tell of them,
    and the others."""
    text_at = names.index("text") if "text" in names else None
    own = whole_rows(docs, names) if text_at is not None else whole_rows(docs, [*names, "text"]).select(F.col("row").dropFields("text").alias("row"), F.col("row.text").alias("text"))
    kept = StructField("row", StructType([docs.schema[n] for n in names]))
    added = StructType.fromDDL(", ".join(f"{n} {kind}" for n, (_, kind) in _SCANNED.items())).fields
    scanned = own.mapInArrow(lambda it: _scan(it, text_at), StructType([kept, *added]))
    scanned = checkpointed(scanned.withColumn("place", F.monotonically_increasing_id()))
    texts = scanned.where("base IS NOT NULL")
    n_texts = texts.count()
    n = F.lit(float(max(1, n_texts)))

    holding = texts.where("size(entities) > 0")
    # copies as one row, with their number
    once = holding.groupBy("key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("entities", "terms", "marks")))
    held = once.select("key", "copies", F.explode("entities").alias("entity"))
    sets = [F.bit_xor(F.xxhash64("key", F.lit(seed))) for seed in (1, 2)]
    entities = held.groupBy("entity").agg(F.sum("copies").alias("df_entity"), F.count("*").alias("n_keys"), F.xxhash64(F.count("*"), *sets).alias("class"))
    # an entity of one text, copies apart, has one source
    telling = entities.where(F.col("n_keys") > 1).where(F.col("df_entity") < n_texts).drop("n_keys")
    held = salted_join(held, telling, ["entity"], "key")
    held = held.select("key", "copies", "class", "df_entity").distinct().join(sources(once.select("key", "marks")), "key")
    held = checkpointed(held)

    # n is at most k / CERTAINTY, so a term in more texts than this tells too little
    bound = F.col("most") / CERTAINTY + 1
    in_texts = scanned.where("base IS NULL").select("words", "counts").mapInArrow(_unpacked, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term"))
    in_texts = checkpointed(in_texts.where("df_term > 1"))
    frequent = in_texts.where(F.col("df_term") > FREQUENT * n_texts)
    own_terms = once.join(held.groupBy("key").agg(F.max("df_entity").alias("most")), "key").select("key", "most", F.explode("terms").alias("term"))
    rest = own_terms.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(in_texts.where(F.col("df_term") <= FREQUENT * n_texts), "term")
    rare = own_terms.join(F.broadcast(frequent), "term").unionByName(rest).where(F.col("df_term") <= bound).drop("most")
    pairs = checkpointed(rare.join(held, "key").where(F.col("df_term") <= F.col("df_entity") / CERTAINTY + 1))
    by_source = pairs.groupBy("class", "term", "df_entity", "df_term", "source").agg(F.sum("copies").alias("copies"))
    telling = (
        by_source.groupBy("class", "term", "df_entity", "df_term")
        .agg(F.count("*").alias("co"), F.sum("copies").alias("both"))
        .where(_disclosed(n, F.col("df_entity"), F.col("df_term"), F.col("co"), F.col("both"), disclosure))
        .select("class", "term")
    )
    terms = salted_join(pairs.select("key", "class", "term"), telling, ["class", "term"], "key").groupBy("key").agg(F.collect_set("term").alias("terms"))
    terms = salted_join(holding.select("place", "key"), terms, ["key"], "place").drop("key")
    holding = holding.drop("terms").join(terms, "place", "left").select(*_FOUND, "held", "terms")
    return holding, texts.where("size(entities) = 0").select(*_FOUND)


def scan_personal_data(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``found`` of every
    text (see :func:`find_personal_data`); ``spans`` are kind:start:end by start, then kind,
    comma-joined, and the hash is that of the base kinds' alone."""
    found = find_personal_data(docs.select("doc_id", "text"), keep=["doc_id"], **options)
    counts = [F.expr(f"CAST(size(filter(base, s -> s.number = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("row.doc_id", *counts, "base_sha256", spans.alias("spans"), "found")


def redacted(text: str | None, found: list[dict]) -> str | None:
    """The text with each run of overlapping spans replaced by its first one's kind."""
    if not text or not found:
        return text
    parts, done, upto = [], 0, -1
    for span in found:
        if span["start"] >= upto:
            parts += [text[done : span["start"]], f"<{span['kind']}>"]
        done = upto = max(upto, span["end"])
    return "".join(parts) + text[done:]


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """The rows of ``docs`` with entities generalised to their kind and telling terms removed
    (as ``<kind>`` and ``<term>``); ``n_chars`` follows the text where there is such a
    column, and all other columns stay."""
    names = docs.columns
    at, kept = names.index("text"), StructField("row", docs.schema)
    holding, others = _assessed(docs, disclosure, names)

    def run(batches):
        for batch in _marked(batches, at):
            rows = batch.column("row")
            columns = [pc.struct_field(rows, [k]) for k in range(len(names))]
            spans = zip(*(batch.column(n).to_pylist() for n in ("base", "found")), strict=True)
            found = [sorted([*a, *b], key=lambda s: (s["start"], s["number"])) for a, b in spans]
            texts = [redacted(t, f) for t, f in zip(columns[at].to_pylist(), found, strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(rows.type))], ["row"])

    return holding.mapInArrow(run, StructType([kept])).unionAll(others.select("row")).select("row.*")
