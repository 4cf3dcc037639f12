"""Secret scans over a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query of trigrams is derived that every match
satisfies.  One pass over a text finds its distinct trigrams among those that some query names,
and the index lists for each of them the texts with it.  Lists are looked up and intersected as
the queries say, and only texts that remain are searched with the rule itself.  Rules without a
mandatory trigram search every text.

The index and its answers hold hashes of texts.  Answers go back to the texts as a broadcast if
they are few, so that texts are never shuffled; past ``BROADCAST_ROWS`` a join on the hash does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed


@dataclass(frozen=True)
class Rule:
    """``least``: characters that group ``group`` has at least, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules in the order of their kinds (fixed values).
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]

#: Published forms of issued credentials (fixed values).
ISSUED = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

#: Texts that rules are to search up to which their list is broadcast: some 50 MB.
BROADCAST_ROWS = 1_000_000
#: Matches of a text whose places are added up together.
CHUNK = 256
#: Alternatives of a literal that are followed before the query gives up telling them apart.
_MOST = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold for any text with a match; a clause holds if the text has, in
    lower case, all trigrams of one of its alternatives.  No clauses: no trigram is needed."""
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted(sets, key=sorted))
        return {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, if they are few."""
        strings = {""}
        for kind, value in items:
            more = options(str(kind), value)
            if more is None or len(strings) * len(more) > _MOST:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    def options(kind: str, value) -> set[str] | None:
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN":
            chars: set[str] = set()
            for part, x in value:
                if str(part) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(part) == "RANGE" and x[1] - x[0] < _MOST:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if kind == "SUBPATTERN":
            return exact(value[3])
        if kind == "BRANCH":
            sets = [exact(x) for x in value[1]]
            return None if None in sets else set().union(*sets)
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            once = exact(inner)
            if once is None or high > 2:
                return None
            return set().union(*(_power(once, n) for n in range(low, high + 1)))
        return {""} if kind == "AT" else None

    def walk(items) -> None:
        strings = {""}
        for kind, value in items:
            more = options(str(kind), value)
            if more is not None and len(strings) * len(more) <= _MOST:
                strings = {a + b for a in strings for b in more}
                continue
            strings = flush(strings)
            if more is not None and len(more) <= _MOST:
                strings = more
            elif str(kind) == "SUBPATTERN":
                walk(value[3])
            elif str(kind) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                walk(value[2])
        flush(strings)

    walk(re._parser.parse(pattern))
    return clauses


def _power(strings: set[str], n: int) -> set[str]:
    out = {""}
    for _ in range(n):
        out = {a + b for a in out for b in strings}
    return out


def _query_rows(rules: list[Rule]) -> list[tuple]:
    """(trigram, rule, clauses of the rule, clause, alternative, its trigrams, bit)."""
    rows = []
    for number, rule in enumerate(rules):
        clauses = trigram_query(rule.pattern)
        for c, alternatives in enumerate(clauses):
            for a, grams in enumerate(alternatives):
                rows += [(g, number, len(clauses), c, a, len(grams), bit) for bit, g in enumerate(sorted(grams))]
    return rows


def _any_of(trigrams: list[str]) -> str:
    """A pattern whose first group is the listed trigram, if any, at each place of a text."""
    plain = lambda c: c if c.isalnum() else f"\\x{{{ord(c):x}}}"
    ahead: dict[str, dict[str, str]] = {}
    for t in trigrams:
        by_second = ahead.setdefault(t[0], {})
        by_second[t[1]] = by_second.get(t[1], "") + plain(t[2])
    branches = [plain(a) + "(?:" + "|".join(f"{plain(b)}[{c}]" for b, c in by_second.items()) + ")" for a, by_second in ahead.items()]
    return f"(?=({'|'.join(branches)}))"


def _candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """(row_key, numbers of the rules whose queries the text satisfies)."""
    rows = _query_rows(rules)
    if not rows:
        return None
    query = docs.sparkSession.createDataFrame(
        rows, "trigram string, rule int, n_clauses int, clause int, alternative int, n_trigrams int, bit int"
    )
    named = F.lit(_any_of(sorted({r[0] for r in rows})))
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), named, F.lit(1)))
    index = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.explode(own).alias("trigram")).repartition("row_key")
    one = lambda c: F.expr(f"shiftleft(1L, {c})")
    return (
        # the queries are derived from a fixed list of rules
        index.join(F.broadcast(query), "trigram")
        .groupBy("row_key", "rule", "n_clauses", "clause", "alternative", "n_trigrams")
        .agg(F.bit_or(one("bit")).alias("got"))
        .where("bit_count(got) = n_trigrams")
        .groupBy("row_key", "rule", "n_clauses")
        .agg(F.bit_or(one("clause")).alias("got"))
        .where("bit_count(got) = n_clauses")
        .groupBy("row_key")
        .agg(F.collect_set("rule").alias("rules"))
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, rule: Rule, number: int) -> Column:
    """Matches of the rule in a text as (start, number, kind, end), in code points: what lies
    between the matches and the matches themselves are counted off in turn, a chunk at a time."""
    pattern = _quoted(rule.pattern)
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    groups = found if rule.group == 0 else f"regexp_extract_all({text}, {pattern}, {rule.group})"
    span = "struct<start:bigint,number:int,kind:string,end:bigint>"
    empty = f"cast(array() AS array<{span}>)"
    chunk = f"""aggregate(c, struct(0L AS at, {empty} AS spans),
        (a, x) -> struct(
          a.at + length(x.`0`) + coalesce(length(x.`1`), 0) AS at,
          CASE WHEN length(x.`2`) >= {rule.least} THEN concat(a.spans, array(struct(
            a.at + length(x.`0`) AS start, {number} AS number, '{rule.kind}' AS kind, a.at + length(x.`0`) + length(x.`1`) AS end)))
          ELSE a.spans END AS spans))"""
    parts = f"arrays_zip(split({text}, {pattern}, -1), {found}, {groups})"
    chunks = f"transform(array({parts}), z -> transform(sequence(0, (size(z) - 1) DIV {CHUNK}), k -> slice(z, k * {CHUNK} + 1, {CHUNK})))[0]"
    return F.expr(f"""
      CASE WHEN {text} RLIKE {_quoted(_sieve(rule))} THEN aggregate(
        transform({chunks}, c -> {chunk}),
        struct(0L AS at, cast(array() AS array<array<{span}>>) AS parts),
        (a, p) -> struct(a.at + p.at AS at, concat(a.parts, array(transform(p.spans, s ->
          struct(s.start + a.at AS start, s.number AS number, s.kind AS kind, s.end + a.at AS end)))) AS parts),
        a -> flatten(a.parts)) ELSE {empty} END""")


def _sieve(rule: Rule) -> str:
    """What any text with a match that isn't dropped has: the pattern itself, or, where its
    measured group ends in a repetition and the pattern with it, at least as much of that as the
    characters before it leave."""
    parsed = list(re._parser.parse(rule.pattern))
    inside = parsed
    if rule.group and parsed and str(parsed[-1][0]) == "SUBPATTERN" and parsed[-1][1][0] == rule.group:
        inside = list(parsed[-1][1][3])
    elif rule.group:
        return rule.pattern
    tail = re.search(r"\](\+)(\)?)$", rule.pattern)
    if not tail or not inside or str(inside[-1][0]) != "MAX_REPEAT" or bool(tail[2]) != bool(rule.group):
        return rule.pattern
    before = re._parser.SubPattern(re._parser.State(), inside[:-1]).getwidth()[1]
    return f"{rule.pattern[: tail.start(1)]}{{{max(1, rule.least - before)},}}{tail[2] or ''}"


def scan_secrets(docs: DataFrame, issued: list[Rule] = ISSUED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Secrets in every text.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Matches of a kind are leftmost
    and don't overlap; those whose value is too short are dropped and not retried.  Returns a
    row per input row: ``doc_id, n_assign, n_access, n_hex`` (base kinds), ``base_sha256``
    and ``spans`` (kind:start:end in code points, by start, then in the order of the rules,
    comma-joined; the hash is over the base kinds' alone) and ``found`` (the same as an array
    of structs).  Texts are read whole.  A null text has no secrets; a null doc_id stays null;
    rows repeated whole get the same values each; an empty table gives an empty one.
    """
    rules = BASE + issued
    named = [number for number, rule in enumerate(rules) if trigram_query(rule.pattern)]
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    candidates, none = _candidates(docs, rules), F.array().cast("array<int>")
    if candidates is None:
        texts = texts.withColumn("rules", none)
    else:
        candidates = checkpointed(candidates)
        few = candidates.count() <= broadcast_rows
        texts = texts.join(F.broadcast(candidates) if few else candidates, "row_key", "left").withColumn("rules", F.coalesce("rules", none))
    nothing = "cast(array() AS array<struct<start:bigint,number:int,kind:string,end:bigint>>)"
    columns = [
        F.when(F.array_contains("rules", n), spans_of("text", r, n)).otherwise(F.expr(nothing)) if n in named else spans_of("text", r, n)
        for n, r in enumerate(rules)
    ]
    spans = texts.select("doc_id", *(col.alias(f"s{n}") for n, col in enumerate(columns)))
    n_base = len(BASE)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    ordered = spans.select(
        "doc_id",
        *(F.size(f"s{n}").cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE)),
        F.array_sort(F.concat(*(f"s{n}" for n in range(n_base)))).alias("base"),
        F.array_sort(F.concat(*(f"s{n}" for n in range(len(rules))))).alias("found"),
    )
    return ordered.select(
        "doc_id", *(f"n_{r.kind}" for r in BASE),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"), "found",
    )
