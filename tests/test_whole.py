"""Queries over their whole input: no id or row subset, no cut texts."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import bundle as bundle_operator
from tarnwick.operators.corpus import GENERATED_MARKS
from tarnwick.params import Params
from tarnwick.plans import adapters, catalogue, retrieval
from tests.test_queries import SF, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def same(spark, duck, name: str, sql: str, at: str = SF) -> list[tuple]:  # noqa: F811
    """The query's rows, columns by name, after they were found equal to the SQL's."""
    df = catalogue.queries()[name](spark, at)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    spark.catalog.clearCache()
    want = duck.sql(sql)
    assert plain(rows) == plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    return rows


def test_searches_take_every_twentieth_vector(spark, duck):  # noqa: F811
    asked = {r["qid"] for r in catalogue.queries()["file_ranking"](spark, SF).select("qid").distinct().collect()}
    spark.catalog.clearCache()
    assert asked == {r[0] for r in duck.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}


def whole_census(rows) -> set[tuple]:
    """rows (doc_id, source, text) -> (by, key, files, bytes), the rules in plain Python over whole texts."""
    marks = re.compile(GENERATED_MARKS, re.I)
    sums: dict[tuple, list[int]] = {}
    for doc_id, source, text in rows:
        size, head = len(text.encode()), text[:2048]
        breaks = head.count("\n")
        generated = marks.search(head) or (len(head) >= 2000 and breaks <= 2) or (breaks and len(head) / (breaks + 1) > 400)
        reason = {1: "excluded", 2: "vendored", 3: "generated"}.get(doc_id % 5) or ("generated" if generated else "too-big" if size > 600_000 else None)
        for key in [("reason", reason)] if reason else [("ext", "md"), ("dir", source)]:
            n = sums.setdefault(key, [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + size
    return {(*k, *v) for k, v in sums.items()}


def test_census_reads_whole_texts(spark, tmp_path):
    line = "some words of a line\n"
    awkward = [line * 9 + "Code generated by a tool", "x" * 2500 + "\n", ("y" * 500 + "\n") * 3, line * 40_000, line * 20, "é" * 70 + "\n", ""]
    rows = [(5 * k, "src0", t) for k, t in enumerate(awkward)] + [(5 * k + k % 5, "src1", line * (k + 9)) for k in range(1, 10)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["by"], r["key"], r["files"], r["bytes"]) for r in catalogue.queries()["census"](spark, str(tmp_path)).collect()}
    assert got == whole_census(rows)
    assert {k for by, k, *_ in got if by == "reason"} == {"excluded", "vendored", "generated", "too-big"}


def test_census_of_the_tables(spark, duck):  # noqa: F811
    got = {(r["by"], r["key"], r["files"], r["bytes"]) for r in catalogue.queries()["census"](spark, SF).collect()}
    assert got == whole_census(duck.sql("SELECT doc_id, source, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with vectors of 60 files, and its SQL connection."""
    import duckdb

    r, at = random.Random(2), str(tmp_path_factory.mktemp("many"))
    rows = [(k, [r.gauss(0, 1) / 8 for _ in range(64)], k % 60) for k in range(180)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["bundle", "selection", "prune", "chunks_for_file", "search_multi", "bundle_full"])
def test_bundles_by_the_default_knobs(spark, many, name):
    at, con = many
    rows = same(spark, con, name, catalogue.oracle_sql()[name], at)
    if name == "bundle":
        ranks, extras = (Counter(r[3] for r in rows if r[6] == via) for via in ("rank", "graph"))
        assert set(ranks.values()) == {12} and max(extras.values()) > 2


def test_small_caps(spark, many):
    at, con = many
    df = bundle_operator.assemble(retrieval.scored(spark, at), adapters.label_edges(spark, at), Params(cand_files=5, graph_extras=2))
    cols = sorted(df.columns)
    want = con.sql(catalogue.oracle_sql()["bundle"].replace("WHERE rank <= 12)", "WHERE rank <= 5)").replace("r WHERE rank > 12 AND", "r WHERE rank > 5 AND").replace("WHERE k <= 7),", "WHERE k <= 2),"))
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(want.project(", ".join(cols)).fetchall())
    spark.catalog.clearCache()
