"""The engine on small repositories: index, search, chunkers, edges, grep, graph, flows, edits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import ask, chunkers, corpus, edges, evaluation, files, flows, graph, grep, mapcard, render, rerank, scoring
from tarnwick.params import Params
from tarnwick.plans import indexer
from tarnwick.sources import embed, scan, store
from tarnwick.streaming import incremental, limiter

REPO = [
    ("src/auth/login.py", 'from billing import invoice\n\n\ndef login_user(name, password):\n    """Log a user in."""\n    token = make_token(name)\n    invoice.create_invoice(name)\n    return token\n\n\ndef make_token(name):\n    return name[::-1]\n'),
    ("src/billing/invoice.py", 'LIMIT = 10\n\n\nclass Invoice:\n    """An invoice."""\n\n    total = 0\n\n    def add(self, amount):\n        self.total += amount\n\n\ndef create_invoice(name):\n    return Invoice()\n'),
    ("src/billing/__init__.py", ""),
    ("src/util/flat.py", "def flatten(rows):\n    return [x for r in rows for x in r]\n"),
    ("tests/test_login.py", "from auth.login import login_user\n\n\ndef test_login():\n    assert login_user('a', 'b')\n"),
    ("README.md", "# Shop\n\nHow users log in.\n\n## Login\n\nCall `login_user`.\n\n```\n# not a heading\n```\n"),
]


@pytest.fixture(scope="module")
def repo(spark):
    return spark.createDataFrame(REPO, "path string, text string")


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    assert indexer.index(spark, repo, root) == {"new": 6}
    return indexer.Engine(spark, root)


def test_index_is_a_partition(engine, repo):
    chunks = engine.tables["chunks"].withColumnRenamed("file", "path")
    assert corpus.partition_violations(chunks, repo).count() == 0


def test_search_finds_the_file_first(engine):
    top = engine.search(["login user token"]).orderBy("tier", "place").first()
    assert top["file"] == "src/auth/login.py" and top["tier"] == 1
    files_ = {r["file"] for r in engine.search(["login user token"]).collect()}
    assert "src/billing/invoice.py" in files_


def test_long_query_is_grounded(engine):
    q = 'Traceback with a long story about how the create invoice amount total went wrong yesterday evening while several customers waited patiently before checkout finished processing their orders including shipping labels printing warehouse notifications emails receipts refunds discounts vouchers\n  File "src/billing/invoice.py", line 9, in add\n'
    top = engine.search([q]).orderBy("tier", "place").first()
    assert top["file"] == "src/billing/invoice.py"


def test_scope_fails_open(engine):
    inside = {r["file"] for r in engine.scored(["login"], scope="tests").select("file").distinct().collect()}
    outside = engine.scored(["login"], scope="nowhere").select("file").distinct().count()
    assert inside == {"tests/test_login.py"} and outside >= 5


def test_edges(engine):
    got = {(r["src"], r["dst"], r["kind"]) for r in engine.tables["edges"].collect()}
    assert ("src/auth/login.py", "src/billing/invoice.py", "import") in got
    assert ("src/auth/login.py", "src/billing/invoice.py", "call") in got
    assert ("tests/test_login.py", "src/auth/login.py", "call") in got
    assert not any(s == d for s, d, _ in got)


def test_incremental(spark, repo, tmp_path):
    root = str(tmp_path / "i")
    indexer.index(spark, repo, root)
    new = repo.where("path <> 'src/util/flat.py'").withColumn("text", F.when(F.col("path") == "README.md", F.lit("# New\n")).otherwise(F.col("text")))
    assert indexer.index(spark, new, root) == {"same": 4, "changed": 1, "orphan": 1}
    e = indexer.Engine(spark, root)
    assert e.tables["files"].count() == 5 and e.tables["chunks"].where("file = 'src/util/flat.py'").count() == 0
    assert ("tests/test_login.py", "src/auth/login.py") in {(r["src"], r["dst"]) for r in e.tables["edges"].collect()}
    assert indexer.index(spark, new, root) == {"same": 5}

    class Broken:
        name = "broken"

        def embed(self, texts):
            raise RuntimeError("down")

    with pytest.raises(Exception):
        indexer.index(spark, repo, root, Broken())
    assert store.Store(spark, root).version() == 3


def test_grep_roles(engine):
    hits = {(r["file"], r["line"]): r for r in engine.grep("login_user").collect()}
    assert hits["src/auth/login.py", 4]["role"] == "defines"
    assert hits["tests/test_login.py", 5]["role"] == "tests" and hits["README.md", 7]["role"] == "docs"
    reads = engine.grep("make_token").where("line = 6").first()
    assert reads["role"] == "reads" and reads["symbol"] == "login_user" and reads["in_degree"] == 1


TS = """import { a } from './util';
import x from '../lib/index.js';
export class Box extends Base {
  size = 1;
  grow(by: number): void {
    this.size += by;
  }
}
export const add = (a: number, b: number) => {
  return a + b;
};
"""
GO_A = 'package shop\n\nimport "example.com/m/pay"\n\nfunc Buy() {\n\tpay.Charge()\n\thelper()\n}\n'
GO_B = "package shop\n\nfunc helper() {}\n"
GO_C = "package pay\n\nfunc Charge() {}\n"
PHP_A = "<?php\nnamespace App;\n\nuse Lib\\Mailer;\n\nclass Signup {\n    public function run() {\n        return new Mailer();\n    }\n}\n"
PHP_B = "<?php\nnamespace Lib;\n\nclass Mailer {}\n"
RB = 'require_relative "../b/two"\nrequire "three"\n\nclass One\n  def run\n    if true\n      1\n    end\n  end\nend\n'
RUST = "pub struct Cup;\n\nimpl Cup {\n    pub fn fill(&self) -> u8 {\n        1\n    }\n}\n\nfn main() {}\n"


def test_chunkers_and_edges_of_other_languages(spark):
    rows = [("web/box.ts", TS), ("web/util.tsx", "export const a = 1;\n"), ("lib/index.ts", "export default 1;\n"), ("shop/a.go", GO_A), ("shop/b.go", GO_B), ("pay/c.go", GO_C), ("app/a.php", PHP_A), ("lib/b.php", PHP_B), ("a/one.rb", RB), ("b/two.rb", "Y = 1\n"), ("gem/lib/three.rb", "X = 1\n"), ("cup.rs", RUST)]
    df = spark.createDataFrame(rows, "path string, text string")
    done = chunkers.parsed(df).persist()
    _, chunks, symbols = chunkers.children(done)
    assert corpus.partition_violations(chunks.withColumnRenamed("file", "path"), df).count() == 0
    names = {(r["file"], r["name"], r["kind"]) for r in symbols.collect()}
    assert {("web/box.ts", "Box", "class"), ("web/box.ts", "Box.grow", "method"), ("web/box.ts", "add", "function"), ("shop/a.go", "Buy", "function"), ("app/a.php", "Signup.run", "method"), ("a/one.rb", "One.run", "method"), ("cup.rs", "Cup.fill", "method"), ("cup.rs", "main", "function")} <= names
    got = {(r["src"], r["dst"], r["kind"]) for r in edges.edges(df).collect()}
    assert got == {("web/box.ts", "web/util.tsx", "import"), ("web/box.ts", "lib/index.ts", "import"), ("shop/a.go", "pay/c.go", "import"), ("shop/a.go", "shop/b.go", "call"), ("app/a.php", "lib/b.php", "import"), ("a/one.rb", "b/two.rb", "import"), ("a/one.rb", "gem/lib/three.rb", "import")}


def test_python_chunker():
    out = chunkers.chunk_file("a.py", REPO[1][1], chunkers.PythonChunker())
    names = {s["name"]: s for s in out["symbols"]}
    assert names["Invoice.add"]["kind"] == "method" and names["LIMIT"]["kind"] == "constant" and names["Invoice"]["doc"] == "An invoice."
    small = chunkers.chunk_file("a.py", REPO[1][1], chunkers.PythonChunker(), 40)
    assert [c["start_line"] for c in small["chunks"][1:]] == [c["end_line"] + 1 for c in small["chunks"][:-1]]
    broken = chunkers.chunk_file("a.py", "def (:\n  x\n", chunkers.PythonChunker())
    assert not broken["parse_ok"] and broken["chunks"][-1]["end_line"] == 2
    assert chunkers.chunk_file("a.py", "", chunkers.PythonChunker())["chunks"] == []


def test_markdown_never_cuts_a_fence():
    text = "# A\n\n" + "word " * 60 + "\n\n## B\n\n```\n" + "code line\n" * 40 + "```\n\n## C\n\n" + "more " * 80 + "\n"
    out = chunkers.chunk_file("x.md", text, chunkers.MarkdownChunker(), 200)
    lines = text.splitlines()
    starts = [c["start_line"] for c in out["chunks"]]
    fence = (lines.index("```") + 1, len(lines) - lines[::-1].index("```"))
    assert len(starts) > 2 and not any(fence[0] < s <= fence[1] for s in starts)
    assert {"A", "B", "C"} == {s["name"] for s in out["symbols"]}


def test_pack_lines(spark):
    import random

    r = random.Random(2)
    rows = [(str(k), "\n".join("x" * r.randint(0, 12) for _ in range(r.randint(0, 30)))) for k in range(40)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {}
    for x in corpus.pack_lines(df, 15).orderBy("path", "start_line").collect():
        got.setdefault(x["path"], []).append((x["start_line"], x["end_line"]))
    for p, t in rows:
        lines = t.splitlines()
        assert got.get(p, []) == (chunkers.line_windows(lines, 1, len(lines), 15) if lines else [])
    assert corpus.partition_violations(corpus.pack_lines(df, 15), df).count() == 0


def test_lines_as_splitlines(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f ", "\n\n", "é\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.lines("t").alias("l"), T.nws("t").alias("n")).collect()
    assert {r["k"]: r["l"] for r in rows} == {k: t.splitlines() for k, t in enumerate(texts)}


def test_gitignore(spark):
    rules = corpus.parse_gitignore("*.log\n/build/\n!keep.log\ndocs/**/draft.md\n# no\n") + corpus.parse_gitignore("*.tmp\n", "sub")
    paths = {"a.log": True, "x/keep.log": False, "build/x.py": True, "src/build/x.py": False, "docs/a/b/draft.md": True, "docs/draft.md": True, "sub/q.tmp": True, "q.tmp": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["i"] for r in df.withColumn("i", corpus.gitignored(F.col("path"), rules)).collect()} == paths


def test_paths(spark):
    rows = [("a/tests/x.py", True, False), ("src/user_test.go", True, False), ("src/latest.py", False, False), ("examples/x.py", False, True), ("a/fixtures/x.py", True, False), ("demo", False, False), ("src/x.spec.ts", True, False)]
    df = spark.createDataFrame(rows, "p string, t boolean, d boolean").select("*", T.is_test_path("p").alias("a"), T.is_demo_path("p").alias("b"), T.norm_rel(F.concat(F.lit("x/../"), F.col("p"))).alias("n")).collect()
    assert all(r["t"] == r["a"] and r["d"] == r["b"] and r["n"] == r["p"] for r in df)


def test_hash_embedder(spark):
    from tarnwick.functions.vectors import hashed_embedding

    texts = ["login user login", "", "Größe x_y"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", hashed_embedding(F.col("t"), 64).alias("v")).collect()
    want = embed.HashEmbedder(64).embed(texts)
    assert all(np.allclose(r["v"], want[r["k"]]) for r in df)
    assert np.isclose(embed.normalised(embed.decoded("AQID")[None])[0] @ np.array([1, 2, 3]), np.sqrt(14))


def test_embedding_cache(spark):
    class Counting(embed.HashEmbedder):
        pass

    rows = spark.createDataFrame([(1, "a b"), (2, "c d")], "k int, text string")
    e = Counting(16)
    first = embed.embedded(rows, e)
    again = embed.embedded(rows, e, cache=embed.cache_rows(first.where("k = 1"), e))
    assert {r["k"]: r["vec"] for r in first.collect()} == {r["k"]: r["vec"] for r in again.collect()}


def test_graph(spark):
    df = spark.createDataFrame([("a", "b", "import"), ("b", "a", "call"), ("b", "c", "import"), ("d", "e", "import"), ("e", "f", "import"), ("d", "f", "call"), ("a", "c", "call"), ("z", "z", "import")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefz"], "path string")
    parts = {r["file"]: r["community"] for r in graph.communities(nodes, df).collect()}
    assert parts["a"] == parts["b"] == parts["c"] != parts["d"] == parts["e"] == parts["f"] and parts["z"] == 2
    assert graph.god_nodes(df, 1).first()["degree"] == 2
    assert graph.shortest_path(df, None, "d", "e") == ["d", "e"] and graph.shortest_path(df, None, "a", "d") == []
    tests = spark.createDataFrame([("a", "tests/t", "import"), ("tests/t", "b", "import"), ("a", "m", "import"), ("m", "n", "import"), ("n", "b", "import")], "src string, dst string, kind string")
    assert graph.shortest_path(tests, None, "a", "b") == ["a", "m", "n", "b"]
    assert {r["file"]: r["hops"] for r in graph.within_hops(df, spark.createDataFrame([("a",)], "file string"), 2).collect()} == {"a": 0, "b": 1, "c": 1}
    sync = {r["file"]: r["community"] for r in graph.synchronous_communities(nodes, df, 4).collect()}
    assert sync["d"] == sync["e"] == sync["f"]
    assert len(graph.fingerprint(nodes, df).first()["fingerprint"]) == 40


def test_resolve_node(spark):
    nodes = spark.createDataFrame([("src/a/x.py", [1.0, 0.0]), ("lib/x.py", [0.0, 1.0]), ("tests/y.py", [0.9, 0.1])], "path string, skel_vec array<double>")
    assert graph.resolve_node(nodes, "lib/x.py").first()["path"] == "lib/x.py"
    assert graph.resolve_node(nodes, "x.py").first()["path"] == "lib/x.py"
    assert graph.resolve_node(nodes, "what", [1.0, 0.0]).first()["path"] == "src/a/x.py"


def test_flows(spark):
    f = spark.createDataFrame([(1, "How does login work", "prose", {"a": "1"}, [1.0, 0.0], [1.0, 0.0], 1.0), (2, "How are invoices paid", "prose", {"b": "1"}, [0.0, 1.0], [0.0, 1.0], 2.0)], "id long, question string, text string, files map<string,string>, vec array<double>, qvec array<double>, created double")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    q = spark.createDataFrame([(0, "login work", [1.0, 0.05]), (1, "invoices paid", [0.05, 1.0]), (2, "login work", [-1.0, -1.0])], "qid long, query string, qvec array<double>")
    assert {r["qid"]: r["id"] for r in flows.serve(f, q, now).collect()} == {0: 1}
    assert [r["id"] for r in flows.stale(f, now).collect()] == [2] and flows.prune_stale(f, now).count() == 1
    again = flows.cache_flows(f, f.where("id = 1").withColumn("id", F.lit(9).cast("long")))
    assert {r["id"] for r in again.collect()} == {2, 9}
    prose = spark.createDataFrame([("a [[1]] b\n```\nx\n```\n**`f.py` L1-2** — g\n*(see `f:L1` above)*\n\n\n\nc",)], "t string").select(T.strip_code("t").alias("p")).first()["p"]
    assert prose == "a  b\n\nc"


def test_rerank():
    chunks = [{"id": k} for k in range(12)]
    assert [c["id"] for c in rerank.judged(chunks, "q", lambda q, own: [own[-1]["id"], 99])] == [7, 11, 0]
    assert rerank.judged(chunks, "q", lambda q, own: 1 / 0) == chunks
    assert rerank.judged(chunks, "q", lambda q, own: []) == chunks


def test_splice_and_pages():
    cands = [{"file": "a.py", "start_line": 5, "end_line": 8, "text": "l5\nl6\n```\nl8"}]
    out = ask.splice("see [[1:6-7]] and [[1:6-7]] and [[4]]", cands)
    assert "**a.py:6-7**" in out and "````python\nl6\n```\n````" in out and "(see a.py:6-7 above)" in out and "[[" not in out
    s, text = ask.Splicer(cands), "x [[1:6-7]] y [[1]]"
    assert "".join([*(s.feed(c) for c in text), s.close()]) == ask.splice(text, cands)
    pages = ask.paginate("a\n" * 50 + "```\n" + "b\n" * 50 + "```\n" + "c\n" * 50, 60)
    assert "".join(pages) == "a\n" * 50 + "```\n" + "b\n" * 50 + "```\n" + "c\n" * 50
    assert all(p.count("```") % 2 == 0 for p in pages)
    assert ask.answer("q", cands, lambda p: iter(["in [[1]]"]), "bundle")["narrated"] and ask.answer("q", cands, None, "bundle")["text"] == "bundle"


def test_read_and_replace(spark, repo, engine, tmp_path):
    got = {(r["seq"], r["sub"]): r for r in files.read_specs(spark, repo, engine.tables["symbols"], ["src/util/flat.py", "src/auth/login.py#make_token,nope", "src/billing/invoice.py:1-1", "no.py"]).collect()}
    assert got[0, 0]["status"] == "ok" and got[1, 0]["text"].startswith("def make_token") and got[1, 1]["status"] == "missing" and got[2, 0]["text"] == "LIMIT = 10" and got[3, 0]["status"] == "missing"
    texts = {"a": "one two two"}
    assert files.apply_edits(texts, [files.Edit("a", "one", "1"), files.Edit("a", "two", "2", 2)])[0] == {"a": "1 2 2"}
    assert files.apply_edits(texts, [files.Edit("a", "one", "1"), files.Edit("a", "two", "2")])[1]
    (tmp_path / "f.txt").write_text("x")
    assert files.replace_files(str(tmp_path), [files.Edit("f.txt", "x", "y"), files.Edit("f.txt", "q", "z")]) and (tmp_path / "f.txt").read_text() == "x"
    assert not files.replace_files(str(tmp_path), [files.Edit("f.txt", "x", "y")]) and (tmp_path / "f.txt").read_text() == "y"
    with pytest.raises(PermissionError):
        files.contained(str(tmp_path), "../x")


def test_rate_limit(spark):
    assert limiter.allow([0, 1, 2, 11, 12], 2, 10) == [True, True, False, True, True]


def test_stream_of_changes(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "path string, text string, seq long"
    spark.createDataFrame([("a.py", "x = 1\n", 1), ("b.py", "y = 1\n", 2)], schema).write.parquet(src)
    run = lambda: incremental.follow(spark, src, str(tmp_path / "t"), str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([("a.py", None, 3), ("b.py", "y = 2\n", 4)], schema).write.mode("append").parquet(src)
    run()
    got = indexer.Engine(spark, str(tmp_path / "i")).tables["chunks"].collect()
    assert [(r["file"], r["text"]) for r in got] == [("b.py", "y = 2")]


def test_scan_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.py").write_bytes(b"a\r\nb\n")
    row = scan.folder(spark, str(tmp_path)).first()
    assert row["path"] == "d/x.py" and row["text"] == "a\nb\n"


def test_evaluation(spark):
    probes = spark.createDataFrame([(0, "f", 1, 10)], "qid int, path string, lo int, hi int")
    a = spark.createDataFrame([(0, 1, "f", 1, 40, 1)], "qid int, id int, path string, start_line int, end_line int, rank int")
    b = spark.createDataFrame([(0, 1, "f", 1, 10, 1)], "qid int, id int, path string, start_line int, end_line int, rank int")
    ma, mb = evaluation.measure(probes, a), evaluation.measure(probes, b)
    assert ma.first()["iou"] == 0.25 and mb.first()["iou"] == 1.0
    assert evaluation.ab_gate(ma, mb).first()["win"] and not evaluation.ab_gate(mb, ma).first()["win"]


def test_map_card(spark, engine):
    q = spark.createDataFrame([(0, "where is create_invoice and Invoice")], "qid int, query string")
    got = {(r["said"], r["file"]) for r in mapcard.defines(q, engine.tables["symbols"]).collect()}
    assert ("create_invoice", "src/billing/invoice.py") in got
    lines = corpus.line_table(spark.createDataFrame(REPO, "path string, text string")).withColumnRenamed("path", "file")
    kinds = {r["kind"] for r in mapcard.trail(spark.createDataFrame([(0, "login_user")], "qid int, said string"), lines, engine.tables["symbols"]).collect()}
    assert kinds == {"defines", "tests", "reads"}


def test_render():
    out = render.render_pruned("needle", [{"id": 1, "file": "a.py", "start_line": 1, "end_line": 400, "text": "\n".join(["hay"] * 300 + ["needle"] + ["hay"] * 99)}], budget=900)
    assert "needle" in out and len(out) < 1200
    assert "(linked)" in render.render_bundle("q", [{"file": "a", "tier": 2, "via": "graph", "score": 1.0, "place": 1}])


def test_params_are_frozen():
    with pytest.raises(Exception):
        Params().rrf_k = 1
    assert scoring.DEFAULTS.rrf_k == 60 and grep.ORDER[0] == "defines"
