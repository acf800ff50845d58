"""Vector functions as column expressions, in doubles and in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast, after it was counted.
SMALL = 100_000


def large(df: DataFrame) -> DataFrame:
    """df, marked for a shuffled join.

    For relations that grow with the corpus: what they take compressed, by which a join is made a broadcast, says
    little of what the driver needs to build it.
    """
    return df.hint("merge")


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most limit rows (SMALL), else for a shuffled join."""
    limit = SMALL if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else large(df)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(a: Column, then) -> Column:
    """then(a), with a worked out once a row instead of wherever it is used."""
    return F.transform(F.array(a), then)[0]


def unit(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    scaled = lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return once(a, scaled)


def hashed_embedding(text: Column, dims: int = 256) -> Column:
    """Bag-of-words vector: each [A-Za-z_]+ of the lower-cased text counts in the bucket of its MD5's first four bytes."""
    bucket = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_]+"), F.lit(0)), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dims)
    counts = once(bucket, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("double")))
    return unit(counts)
