"""Texts of Arrow batches as bytes, and operators that add columns to a batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts are worked on in pieces of about so many bytes, so memory doesn't follow the batch; a text is never cut.
PIECE = 1 << 19
#: Arrow batches between the JVM and Python, in bytes: several tasks of an executor hold one at a time on both sides.
BATCH_BYTES = 8 << 20


def sized(df: DataFrame) -> DataFrame:
    """df; from now on the session sends Arrow batches of at most BATCH_BYTES, as texts may be long."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub("[^0-9-]", "", conf.get(name)) or -1)
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return pc.fill_null(column, b"").to_pylist()


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batch of about PIECE bytes of text, with the texts."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > PIECE:
            part = batch.slice(start, i - start)
            yield part, raw(part.column(column))
            start, total = i, 0
        total += n
    if start < len(lengths):
        part = batch.slice(start)
        yield part, raw(part.column(column))


def with_columns(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[list[bytes]], dict[str, list]]], keep_text: bool = True) -> DataFrame:
    """df with the columns of schema, which a function of a list of texts returns.

    make() runs once a task and returns that function.  Columns of df with the same
    names are replaced; the text can be left out of what goes back to the JVM.
    """
    added = StructType.fromDDL(schema)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep_text or f.name != text_col)]
    out = StructType(kept + list(added))
    target = to_arrow_schema(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in it:
            for part, texts in pieces(batch, text_col):
                cols = fn(texts)
                arrays = [part.column(f.name) for f in kept] + [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], type=target.field(f.name).type) for f in added]
                yield pa.RecordBatch.from_arrays([a.cast(t.type) if a.type != t.type else a for a, t in zip(arrays, target)], schema=target)

    return sized(df).mapInArrow(run, out)


def whole_groups(it: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by keys (longs), with where each group begins and the end.

    Holds one batch and one group at a time.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def done() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        first = np.ones(rows.num_rows, dtype=bool)
        first[1:] = False
        for k in keys:
            v = rows.column(k).to_numpy()
            first[1:] |= v[1:] != v[:-1]
        return rows, np.append(np.flatnonzero(first), rows.num_rows)

    for batch in it:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        end = []
        for k in keys:
            v = batch.column(k).to_numpy()
            same &= v == v[-1]
            end.append(v[-1])
        cut = 0 if same.all() else int(len(same) - np.argmin(same[::-1]))
        if cut or last != tuple(end):
            held += [batch.slice(0, cut)] if cut else []
            if held:
                yield done()
            held = []
        held.append(batch.slice(cut))
        last = tuple(end)
    if held:
        yield done()
