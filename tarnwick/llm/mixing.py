"""Mixing sources to target weights by pivotal dependent rounding.

A document's copy probability is its source's target over the source's size, 0 to 2.
The whole part is taken for certain.  The fractional parts of a source are rounded
together: two documents meet, and mass moves at random from one to the other, so that
the expected words stay the same and the words of the pair stay the same exactly, until
one of the two is whole.  What is left of a group, one document, meets the leftovers of
other groups in the next level of a reduction tree, FAN groups at a time; the last one
of a source is drawn by its probability.  So a source's words miss its target by less
than one document, and each document is taken floor or ceil of its probability times.

Groups are (source, bucket), the bucket from a hash of the document's id, about GROUP
documents each, so a source of any share of the rows is dealt to many tasks, and reruns
agree whatever the partitions.

Null texts and texts without words have size 0 and take 0 words; a null source is a
source of its own, ordered last.  Every row is a unit of its own, named by source, id, size, a hash
of its text and its number among rows that agree in all of these, so null or repeated ids cost no
precision; which of such equal rows gets which number doesn't matter.  Ties are in that order.
Very long texts are counted whole.  An empty table gives an empty result.  mix() carries extra columns
along, whatever their names but for those that begin with _tw_.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import WORD, few, stored

SPACE = r"[\x20\x09-\x0D]"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
GROUP = 4096
FAN = 256
SEED = 20


def n_words(col: Column) -> Column:
    """Number of words, without building them: each word with the spaces before it becomes one character."""
    marks = F.regexp_replace(F.coalesce(col, F.lit("")), SPACE + "*" + WORD, "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, rows) with target: shares by weight, stopped at MOST times the size.

    Resharing the excess until none is above is filling water to one level: with sources
    sorted by cap over weight, those below the level stop at their cap.  It runs over one
    row a source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("_w", F.element_at(F.lit(list(WEIGHTS)), ((F.row_number().over(w) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    df = df.withColumns({"_cap": F.col("source_size") * MOST, "_all": F.sum("source_size").over(Window.partitionBy()) * SHARE})
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    df = df.withColumns({"_below": F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_rest": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))})
    df = df.withColumn("_level", (F.col("_all") - F.col("_below")) / F.col("_rest"))
    free = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(Window.partitionBy())
    df = df.withColumn("target", F.least(F.col("_cap"), F.coalesce(free, F.lit(float("inf"))) * F.col("_w")))
    return df.select("source", "source_size", "rows", "target")


def _round_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pivotal rounding of one group; at most one row keeps a fraction strictly between 0 and 1, none in a source's last group."""
    pdf = pdf.sort_values(["_tw_u", "_tw_id", "_tw_size", "_tw_hash", "_tw_no"], kind="stable")
    p, size, u = pdf["_tw_p"].to_numpy(float).copy(), pdf["_tw_size"].to_numpy(float), pdf["_tw_u"].to_numpy(float)
    last = pdf["_tw_width"].iloc[0] == 1
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if size[j] <= 0:
            p[j] = float(u[j] < p[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = held, j
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that may move from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        if u[j] * (up + down) < down:
            move = up
        else:
            move = -down
        q = p[a] + move / size[a], p[b] - move / size[b]
        if move > 0:
            fixed = (1.0, q[1]) if (1 - p[a]) * size[a] <= p[b] * size[b] else (q[0], 0.0)
        else:
            fixed = (0.0, q[1]) if p[a] * size[a] <= (1 - p[b]) * size[b] else (q[0], 1.0)
        p[a], p[b] = (min(1.0, max(0.0, x if abs(x - round(x)) > 1e-12 else round(x))) for x in fixed)
        held = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else -1
    if last and held >= 0:
        p[held] = float((u[held] * 7919.0) % 1.0 < p[held])
    return pdf.assign(_tw_p=p)


def rounded(units: DataFrame) -> DataFrame:
    """units (with _tw_source_size, _tw_source_rows, _tw_target) with _tw_copies, by the reduction tree."""
    ratio = F.when(F.col("_tw_source_size") > 0, F.col("_tw_target") / F.col("_tw_source_size")).otherwise(F.lit(1.0))
    id_ = F.coalesce(F.col("_tw_id"), F.lit(-(2**63)))
    rows = units.withColumns({
        "_tw_base": F.floor(ratio).cast("int"), "_tw_p": ratio - F.floor(ratio),
        "_tw_u": (F.pmod(F.xxhash64(id_, "_tw_size", "_tw_hash", "_tw_no", F.lit(SEED)), F.lit(2**52)) + 0.5) / float(2**52),
        "_tw_width": F.ceil(F.col("_tw_source_rows") / GROUP).cast("long"),
    }).withColumn("_tw_bucket", F.pmod(F.xxhash64(id_, "_tw_size", "_tw_hash", "_tw_no", F.lit(SEED + 1)), F.col("_tw_width")))
    schema, open_ = rows.schema, (F.col("_tw_p") > 0) & (F.col("_tw_p") < 1)
    width = units.agg(F.max("_tw_source_rows")).first()[0] or 1
    width = -(-width // GROUP)
    done: list[DataFrame] = []
    while True:
        rows = stored(rows.groupBy("_tw_source", "_tw_bucket").applyInPandas(_round_group, schema))
        done.append(rows.where(~open_))
        if width == 1:
            break
        width = -(-width // FAN)
        rows = rows.where(open_).withColumns({"_tw_bucket": F.floor(F.col("_tw_bucket") / FAN), "_tw_width": F.ceil(F.col("_tw_width") / FAN).cast("long")})
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumn("_tw_copies", F.col("_tw_base") + F.col("_tw_p").cast("int")).drop("_tw_base", "_tw_p", "_tw_u", "_tw_width", "_tw_bucket")


KEY = ["_tw_source", "_tw_id", "_tw_size", "_tw_hash"]


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    return {"_tw_source": F.col(source_col), "_tw_id": F.col(id_col).cast("long"), "_tw_size": n_words(F.col(text_col)), "_tw_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: KEY, _tw_no (1, 2, ... among equal ones), _tw_rows of them, _tw_source_size, _tw_target, _tw_copies."""
    keys = stored(docs.select(*[c.alias(k) for k, c in _named(docs, id_col, text_col, source_col).items()]).groupBy(*KEY).agg(F.count("*").alias("_tw_rows")))
    sources = stored(targets(keys.groupBy(F.col("_tw_source").alias("source")).agg(F.sum(F.col("_tw_size") * F.col("_tw_rows")).alias("source_size"), F.sum("_tw_rows").alias("rows"))), 1)
    sources = sources.select(F.col("source").alias("_tw_s"), F.col("source_size").alias("_tw_source_size"), F.col("rows").alias("_tw_source_rows"), F.col("target").alias("_tw_target"))
    step = 10_000  # numbers of a large group of equal rows are made in two steps, never in one list
    last = F.least(F.col("_tw_from") + step - 1, F.col("_tw_rows"))
    units = keys.withColumn("_tw_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_tw_rows"), F.lit(step).cast("long")))).withColumn("_tw_no", F.explode(F.sequence(F.col("_tw_from"), last))).drop("_tw_from")
    return rounded(units.join(F.broadcast(sources) if few(sources, 100_000) else sources, F.col("_tw_source").eqNullSafe(F.col("_tw_s"))).drop("_tw_s"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with the columns of docs."""
    made = decided(docs, id_col, text_col, source_col)
    here = docs.withColumns(_named(docs, id_col, text_col, source_col))
    other = [F.col(k).alias(f"{k}_") for k in KEY]
    same = lambda keys: [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    times = F.explode(F.array_repeat(F.lit(1), F.col("_tw_copies")))
    single = made.where("_tw_rows = 1 and _tw_copies > 0").select(*other, "_tw_copies")
    out = here.join(single, same(KEY)).withColumn("_tw_each", times).select(*docs.columns)
    twice = made.where("_tw_rows > 1")
    if twice.isEmpty():
        return out
    keys = stored(twice.select(*other).distinct())
    own = stored(here.join(keys, same(KEY), "left_semi").withColumn("_tw_part", F.spark_partition_id()))  # stored, so that a row keeps its part
    parts = own.groupBy(*KEY, "_tw_part").agg(F.count("*").alias("_tw_n"))
    before = parts.withColumn("_tw_before", F.sum("_tw_n").over(Window.partitionBy(*KEY).orderBy("_tw_part")) - F.col("_tw_n")).drop("_tw_n").withColumnsRenamed({k: f"{k}_" for k in [*KEY, "_tw_part"]})
    number = F.row_number().over(Window.partitionBy(*KEY, "_tw_part").orderBy(F.lit(1)))
    numbered = own.withColumn("_tw_rn", number).join(before, same([*KEY, "_tw_part"])).withColumn("_tw_no", F.col("_tw_before") + F.col("_tw_rn")).drop("_tw_before", "_tw_rn", "_tw_part_", *[f"{k}_" for k in KEY])
    taken = twice.where("_tw_copies > 0").select(*other, F.col("_tw_no").alias("_tw_no_"), "_tw_copies")
    return out.union(numbered.join(taken, same([*KEY, "_tw_no"])).withColumn("_tw_each", times).select(*docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of decided() over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return decided(docs).select(
        F.col("_tw_id").alias("doc_id"), F.col("_tw_size").alias("size"), F.col("_tw_source_size").alias("source_size"),
        F.col("_tw_target").alias("target"), (F.col("_tw_copies") * F.col("_tw_size")).alias("taken"),
    )
