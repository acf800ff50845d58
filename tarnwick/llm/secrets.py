"""Secret scans by a trigram inverted index, in DataFrame functions alone.

For each rule a Boolean query over trigrams of the lower-cased text is derived from the
rule's regular expression: the strings a match must begin with or hold are worked out
part by part, and each asks for all of its trigrams.  Only trigrams that some query asks
for are indexed: postings are rows (trigram, document key), stored in the shared folder.
A query is a choice of conjunctions; intersecting postings is a count per document and
conjunction, aggregated before the shuffle, so no posting list is ever gathered and a
trigram that every document has does no harm.  Candidates are verified with the regular
expression itself.  Rules without mandatory trigrams scan every text.

Matches are leftmost and do not overlap within a kind; positions are code points, worked
out from the lengths of the matches and of what lies between them.

Null texts count as empty; a text without matches has empty spans.  Repeated rows get
equal results; a null id is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import few, stored, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length must reach least, else the match is dropped
    least: int = 0
    base: bool = False


# The rules.  Kinds are in the order of the output.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
STRINGS = 24  # a set of strings that grows beyond this is turned into a query
CLASS = 6  # a class of more characters than this counts as any character
BLOCK = 512

#: A query in disjunctive form: any of these sets of trigrams; the empty set asks for nothing.
Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


def _least(q: Query) -> Query:
    """Without conjunctions that ask for more than another."""
    return frozenset(c for c in q if not any(o < c for o in q))


def _both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= 64 else min(a, b, key=lambda q: (q == ALL, len(q)))


def _of(strings: frozenset[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    """The strings that the nodes match, if they are few, and the query that every match meets."""
    held, query, exact = frozenset([""]), ALL, True
    for op, arg in nodes:
        strings, own = _node(op, arg)
        if strings is not None and len(held) * len(strings) <= STRINGS:
            held = frozenset(a + b for a in held for b in strings)
            continue
        query, exact = _both(_both(query, _of(held)), own if strings is None else ALL), False
        held = strings if strings is not None else frozenset([""])
    return (held, ALL) if exact else (None, _both(query, _of(held)))


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), ALL
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < CLASS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (frozenset(chars), ALL) if len(chars) <= CLASS else (None, ALL)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return frozenset().union(*(s for s, _ in parts)), ALL
        return None, _least(frozenset().union(*(_of(s) if s is not None else q for s, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, sub = arg
        strings, query = _sequence(sub)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ALL
        if strings is not None and least == most and len(strings) ** least <= STRINGS:
            return _sequence(list(sub) * least)
        return None, (_both(query, _of(strings)) if strings is not None else query) if least else ALL
    if op is sre.AT:
        return frozenset([""]), ALL
    return None, ALL


def trigram_query(pattern: str) -> Query:
    strings, query = _sequence(_parser.parse(pattern))
    return _of(strings) if strings is not None else query


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """docs (key, text) -> rows (gram, key), a row for each of the grams that the lower-cased text holds."""
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(held).alias("gram")).select("gram", "key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, list[bool]]:
    """Rows (key, mask): which rules the trigrams of a document allow; and which rules scan fully."""
    queries = [trigram_query(r.pattern) for r in rules]
    full = [frozenset() in q for q in queries]
    asked = [(i, j, 1 << i, g, len(c)) for i, q in enumerate(queries) if not full[i] for j, c in enumerate(sorted(q, key=sorted)) for g in sorted(c)]
    if not asked:
        return None, full
    index = stored(postings(docs, sorted({a[3] for a in asked})))
    query = docs.sparkSession.createDataFrame(asked, "rule int, part int, bit long, gram string, needs int")  # as long as the rules
    met = index.distinct().join(F.broadcast(query), "gram").groupBy("key", "rule", "part").agg(F.count("*").alias("n"), F.max("needs").alias("needs"), F.max("bit").alias("bit")).where("n = needs")
    return stored(met.groupBy("key").agg(F.bit_or("bit").alias("mask"))), full


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, rule: Rule) -> Column:
    """array<struct<s,e>> of the matches, in code points; runs in blocks, so the work per match stays bounded."""
    pattern = F.lit(rule.pattern)
    gaps = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len")))
    if rule.group:
        gaps = F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (F.length(g) >= rule.least).alias("ok")))
    else:
        gaps = F.transform(gaps, lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (x["len"] >= rule.least).alias("ok")))
    steps = F.filter(gaps, lambda x: x["len"].isNotNull())
    span = "array<struct<s:int,e:int,ok:boolean>>"

    def block(at: Column, own: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(span).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["gap"]
            return F.struct((s + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["len"]).alias("e"), x["ok"].alias("ok")))).alias("out"))

        return F.aggregate(own, start, step, lambda acc: acc["out"])

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, own: Column) -> Column:
            size = F.aggregate(own, F.lit(0), lambda n, x: n + x["gap"] + x["len"])
            return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        starts = F.aggregate(parts, start, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, starts, lambda own, at: block(at, own)))

    spans = let(steps, lambda all_: F.when(F.size(all_) > 0, let(blocks(all_), placed)).otherwise(F.array().cast(span)))
    return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def quick(rule: Rule) -> str:
    """A pattern that is found wherever the rule's is: cheaper, as it need not run to the end of a match."""
    return re.sub(r"\{(\d+),\}$", r"{\1}", rule.pattern)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' id with a column of spans, array<struct<s,e>>, for each rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key"))
    masks, full = candidates(keyed, rules)
    if masks is None:
        marked = keyed.withColumn("mask", F.lit(0).cast("long"))
    else:
        marked = keyed.join(F.broadcast(masks) if few(masks) else masks, "key", "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    bit = [F.lit(True) if full[i] else F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(rules))]
    return marked.select(F.col("id").alias(id_col), *[F.when(F.coalesce(b, F.lit(False)) & F.col("text").rlike(quick(r)), found(F.col("text"), r)).otherwise(none).alias(r.kind) for b, r in zip(bit, rules)])


def joined_spans(kinds: list[str]) -> Column:
    """kind:start:end of the spans in the columns kinds, by start, then kind as listed, comma-joined."""

    def named(i: int, k: str) -> Column:
        return F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")).alias("t")))

    each = [named(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["t"]), ",")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    df = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return df.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans([r.kind for r in RULES]).alias("spans"))


def _kind_sql(rule: Rule) -> str:
    pattern = rule.pattern
    if rule.kind == "assign":
        pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in "password passwd secret token api_?key".split()))
    p = pattern.replace("'", "''")
    return f"""
  SELECT k, '{rule.kind}' AS kind, {RULES.index(rule)} AS o, CAST(list_sum(list_transform(gap[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(hit[i]) AS n, length(own[i]) AS m
  FROM (SELECT k, unnest(range(1, len(hit) + 1)) AS i, gap, hit, own FROM (
    SELECT k, regexp_split_to_array(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {rule.group}) AS own FROM doc WHERE regexp_matches(t, '{p}')))
  WHERE m >= {rule.least}"""


OP8_SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
span AS ({" UNION ALL ".join(_kind_sql(r) for r in RULES)}),
one AS (SELECT k, o, kind, s, kind || ':' || s || ':' || (s + n) AS t FROM span),
own AS (SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(t, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(t, ',' ORDER BY s, o) AS spans FROM one GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN own USING (k)
"""
