"""Benchmark decontamination as a prefix-filtered set join.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window).  Its
tokens are its SHINGLE-word shingles; a document that holds the window holds all of them.

1. Shingles of the benchmark are counted over all documents.  A window with a shingle that no
   document has cannot occur and goes.  The shingles of the others are ordered by rarity; as all
   must be held, the rarest alone is the necessary prefix.
2. Each place of a prefix token in a document becomes a row with the words around it, and the
   rows are joined with the windows on that token.  The token's offset in the window proposes one
   start; starts that would begin before or end after the document are dropped (positional and
   length bounds).
3. What is left is verified word by word over the window, exactly.

Windows, counts and places are tables; nothing of the benchmark's or the documents' size is
collected or broadcast.  What tasks get is a Bloom filter of the tokens, of at most BLOOM_BITS
bits, which keeps other places out of the shuffle (a fuller filter costs rows, never matches),
and the salts of at most MOST_HOT tokens that are so frequent that their rows are dealt to several
tasks.  Documents are read twice and their texts are never shuffled; equal texts are joined once.

Null, empty and wordless texts have no words and no hits; items without words or with
null text are skipped, an item with null id has the id ''.  An empty table of either kind
gives no hits.  Repeated documents or items are treated alike; ties in rarity go to the smaller
token.  Very long texts are worked on whole.  Columns of the input named n_words, spans or items
are replaced, others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwick.llm.arrow import pieces, sized
from tarnwick.llm.common import only_in, stored, table
from tarnwick.llm.jaccard import LENGTHS, M1, SHINGLE, WordHashes, mix

WINDOW = 13
BLOOM_BITS = 1 << 27
BITS_A_TOKEN = 16
MOST_HOT = 10_000
HOT = 2_000  # rows of a token from which they are dealt to several tasks, at least
#: Bytes of words: digits, letters a-z (A-Z fall on them) and all above ASCII; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PLACED = "n_words long, _tw_places array<struct<h:long,salt:int,p:int,at:int,around:string>>"
SPANS = "array<struct<start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def tokens(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, from the hashes of the words."""
    n = max(0, len(w) - k + 1)
    h = w[:n].copy()
    for j in range(1, k):
        h *= M1
        h += w[j : n + j]
    return mix(h + LENGTHS[k])


def windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: win (its words), n, tokens (in order), and items, the sorted ids that have it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            for part, texts in pieces(batch, "text"):
                for item, text in zip(part.column("item").to_pylist(), texts):
                    own = words(text)
                    n, k = min(WINDOW, len(own)), min(SHINGLE, len(own))
                    h = tokens(np.fromiter(map(hashes.__getitem__, own), dtype=np.uint64, count=len(own)), k).view(np.int64) if own else None
                    for at in range(0, len(own) - n + 1 if own else 0, 4096):
                        starts = range(at, min(at + 4096, len(own) - n + 1))
                        wins = [b" ".join(own[i : i + n]).decode("utf-8", "replace") for i in starts]
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(wins)), pa.array(wins), pa.array([n] * len(wins), pa.int32()), pa.array([h[i : i + n - k + 1] for i in starts], pa.list_(pa.int64()))], ["item", "win", "n", "tokens"])

    rows = sized(benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null"))
    rows = rows.mapInArrow(run, "item string, win string, n int, tokens array<long>")
    return rows.groupBy("win").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items"))


class Bloom:
    """Bits of a set of tokens.  held() is never wrong for a token of the set."""

    SHIFTS = (0, 18, 36)

    def __init__(self, df: DataFrame):
        """df: distinct tokens h.  At most BLOOM_BITS / 64 rows come to the driver."""
        self.mask = min(BLOOM_BITS, 1 << max(12, int(df.count() * BITS_A_TOKEN).bit_length())) - 1
        at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(self.mask).cast("long")) for s in self.SHIFTS]))
        rows = df.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
        self.bits = np.zeros((self.mask + 1) // 64, dtype=np.uint64)
        self.bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def held(self, h: np.ndarray) -> np.ndarray:
        """The places of h whose tokens may be of the set."""
        at = np.arange(len(h))
        for s in self.SHIFTS:
            p = (h[at] >> np.uint64(s)) & np.uint64(self.mask)
            at = at[(self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0]
        return at


def _places(texts: list[bytes], lengths: list[int], bloom: Bloom, hashes: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the text, place and token of each place that the filter lets through."""
    split = [words(t) for t in texts]
    base = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    w = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=int(base[-1]))
    docs, at, hs = [], [], []
    for k in lengths:
        h = tokens(w, k)
        p = bloom.held(h)
        d = np.searchsorted(base, p, side="right") - 1
        inside = p + k <= base[d + 1]
        p, d = p[inside], d[inside]
        docs.append(d)
        at.append(p - base[d])
        hs.append(h[p])
    return split, np.concatenate(docs), np.concatenate(at), np.concatenate(hs)


def counted(docs: DataFrame, text_col: str, lengths: list[int], bloom: Bloom) -> DataFrame:
    """How often tokens occur in all documents: rows (h, freq); others than the filter's come seldom."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            for _, texts in pieces(batch, text_col):
                h, n = np.unique(_places(texts, lengths, shared.value, hashes)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return sized(docs.select(text_col)).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("freq"))


def prefixes(wins: DataFrame, freq: DataFrame) -> DataFrame:
    """Windows all of whose tokens occur, with the rarest: its hash h, its offset in words, its frequency."""
    rows = wins.select("win", "n", F.md5(F.array_join("items", "\x01")).alias("own"), F.size("tokens").alias("all"), F.posexplode("tokens").alias("off", "h")).join(freq, "h")
    rare = rows.groupBy("win").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("all").alias("all"), F.count("*").alias("held"), F.min(F.struct("freq", "h", "off")).alias("r"))
    return rare.where("held = all").select("win", "n", "own", "r.*")


def placed(docs: DataFrame, text_col: str, lengths: list[int], bloom: Bloom, salts: dict[int, int]) -> DataFrame:
    """docs (with _tw_key, without the text) with n_words and _tw_places: prefix tokens with the words around them."""
    shared = docs.sparkSession.sparkContext.broadcast((bloom, salts))
    kept = [f for f in docs.schema if f.name != text_col]
    schema = StructType(kept + list(StructType.fromDDL(PLACED)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (own_bloom, own_salts) = WordHashes(), shared.value
        kind = pa.list_(pa.struct([("h", pa.int64()), ("salt", pa.int32()), ("p", pa.int32()), ("at", pa.int32()), ("around", pa.string())]))
        for batch in it:
            for part, texts in pieces(batch, text_col):
                split, docs_, at, hs = _places(texts, lengths, own_bloom, hashes)
                keys = part.column("_tw_key").to_pylist()
                out: list[list[dict]] = [[] for _ in texts]
                for d, p, h in zip(docs_.tolist(), at.tolist(), hs.view(np.int64).tolist()):
                    lo = max(0, p - WINDOW + 1)
                    salt = (int(keys[d][:7], 16) + p) % own_salts.get(h, 1)
                    out[d].append({"h": h, "salt": salt, "p": p, "at": p - lo, "around": b" ".join(split[d][lo : p + WINDOW]).decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array([len(s) for s in split], pa.int64()), pa.array(out, kind)], [f.name for f in kept] + ["n_words", "_tw_places"])

    return sized(docs).mapInArrow(run, schema)


def merged(found: DataFrame) -> DataFrame:
    """found (key, n_words, spans) with overlapping and touching spans joined."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for spans in batch.column("spans").to_pylist():
                own: list[dict] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    if own and s <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], e)
                    else:
                        own.append({"start": s, "end": e})
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("_tw_key"), batch.column("n_words"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["_tw_key", "n_words", "spans"])

    return sized(found).mapInArrow(run, f"_tw_key string, n_words long, spans {SPANS}")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def found(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs without their texts, with _tw_key and n_words; and of each different text with hits _tw_key, n_words, spans, items."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]).withColumn("_tw_key", text_key(F.col(text_col)))
    wins = stored(windows(benchmark, item_col, item_text_col))
    lengths = [r[0] for r in wins.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()] or [SHINGLE]  # at most SHINGLE rows
    all_tokens = wins.select(F.explode("tokens").alias("h")).distinct()
    rare = stored(prefixes(wins, counted(docs, text_col, lengths, Bloom(all_tokens))))
    by = rare.groupBy("h").agg(F.max("freq").alias("freq"))
    cut = max(HOT, (by.agg(F.sum("freq")).first()[0] or 0) // MOST_HOT)
    hot = by.where(F.col("freq") > cut).select("h", F.ceil(F.col("freq") / cut).cast("int").alias("salts"))
    salts = {r["h"]: r["salts"] for r in hot.collect()}  # fewer than MOST_HOT rows, as each has over a MOST_HOT-th of all
    rows = stored(placed(docs, text_col, lengths, Bloom(by.select("h")), salts))
    places = rows.where(F.size("_tw_places") > 0).select("_tw_key", "n_words", "_tw_places").dropDuplicates(["_tw_key"]).select("_tw_key", "n_words", F.explode("_tw_places").alias("x")).select("_tw_key", "n_words", "x.*")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    sides = rare.join(F.broadcast(hot), "h", "left").select("h", every, "off", "n", "win", "own")
    start = F.col("at") - F.col("off")
    around = F.split("around", " ")
    inside = (start >= 0) & (start + F.col("n") <= F.size(around))
    hit = places.join(sides, ["h", "salt"]).where(inside & (F.array_join(F.slice(around, start + 1, F.col("n")), " ") == F.col("win")))
    hit = hit.select("_tw_key", "n_words", F.struct((F.col("p") - F.col("off")).alias("start"), (F.col("p") - F.col("off") + F.col("n")).alias("end")).alias("span"), "own")
    sums = stored(hit.groupBy("_tw_key").agg(F.first("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("own").alias("own")))  # as many as a text has places
    sets = wins.select(F.md5(F.array_join("items", "\x01")).alias("own"), "items").dropDuplicates(["own"])
    items = sums.select("_tw_key", F.explode("own").alias("own")).join(sets, "own").select("_tw_key", F.explode("items").alias("item")).groupBy("_tw_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.drop("_tw_places"), stored(merged(sums.select("_tw_key", "n_words", "spans")).join(items, "_tw_key"))


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without their texts, with n_words, spans (word places hit, end exclusive, merged) and items (ids as strings, sorted)."""
    rows, hits_ = found(docs, benchmark, text_col, item_col, item_text_col)
    out = rows.join(hits_.drop("n_words"), "_tw_key", "left").drop("_tw_key")
    return out.withColumns({"spans": F.coalesce("spans", F.lit([]).cast(SPANS)), "items": F.coalesce("items", F.lit([]).cast("array<string>"))})


def hits(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def leaked(spans: Column, n_words: Column) -> Column:
    """Whether a whole window of WINDOW words occurs, in a text of any length, or shorter items make up a twentieth of it."""
    return F.exists(spans, lambda s: s["end"] - s["start"] >= WINDOW) | contaminated(hits(spans), n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, without those whose text leaks a part of the benchmark."""
    own = docs.select("*", text_key(F.col(text_col)).alias("_tw_gone"))
    _, hits_ = found(docs.select(F.col(text_col).alias("text")), benchmark, "text", item_col, item_text_col)
    gone = stored(hits_.where(leaked(F.col("spans"), F.col("n_words"))).select(F.col("_tw_key").alias("_tw_gone")))
    return only_in(own, gone, "_tw_gone", "left_anti").drop("_tw_gone")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of matches() over all documents and the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = matches(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).withColumn("n_hit", hits(F.col("spans")))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP5_SQL = """
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
place AS (
  SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT k, i, place.n, item FROM place JOIN win ON place.win = win.win AND place.n = win.n),
word AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
own AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (k) LEFT JOIN own USING (k)
"""
