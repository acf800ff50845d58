"""Relations that grow with the corpus are joined by shuffles: nothing of them is built on the driver."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from tarnwick.functions import vectors
from tarnwick.operators import chunkers, edges, evaluation, links
from tarnwick.plans import catalogue
from tests.test_queries import SF

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def joins(df) -> list[str]:
    """Joins of the plan that would run, before adaptive execution."""
    return re.findall(r"\b(?:Broadcast\w+Join|SortMergeJoin|ShuffledHashJoin|CartesianProduct)\b", df._jdf.queryExecution().sparkPlan().toString())


def test_texts_too_deep_for_the_parser(spark):
    """Prose read as Python may overflow the parser's stack; such a file is cut by lines and holds no mentions."""
    files = spark.createDataFrame([("a.py", "- " * 30_000 + "1\nx\n"), ("b.py", "def f(x=" + "-".join("a" * 20_000) + "):\n    pass\n"), ("c.py", "import a\n")], "path string, text string")
    got = {r["path"]: (r["parse_ok"], [(c["start_line"], c["end_line"]) for c in r["chunks"]]) for r in chunkers.parsed(files).collect()}
    assert got == {"a.py": (False, [(1, 1), (2, 2)]), "b.py": (False, [(1, 1), (2, 2)]), "c.py": (True, [(1, 1)])}
    assert [tuple(r) for r in edges.edges(files).collect()] == [("c.py", "a.py", "import")]
    assert links.use_sites(files).collect() == []
    assert evaluation.python_probes(files.where("path = 'a.py'")).collect() == []


@pytest.mark.parametrize("name", ["code_edges", "map_defines", "map_trail", "map_links", "inferred_sites", "issue_pins", "issue_apply", "file_links", "use_sites", "map_outline", "replace_rows", "replace_edges", "embed_cache_miss", "flow_prune", "flow_stale"])
def test_no_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(vectors, "SMALL", 0)  # as if every side were large
    found = joins(catalogue.queries()[name](spark, SF))
    spark.catalog.clearCache()
    assert found and not [j for j in found if j.startswith("Broadcast")]
