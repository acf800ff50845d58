"""Page scripts of PHP, probes of Python files, shapes, and the caller's own lanes."""

from __future__ import annotations

from tarnwick.operators import chunkers as C
from tarnwick.operators import evaluation, forge, scoring
from tarnwick.operators.php import PhpChunker, is_page_script, layout

STATEMENTS = "".join(f"$row_{k} = load_the_row({k}, 'some; {{ text', \"more ?> text\");\n" for k in range(12))
PAGE = (
    "<?php\n//----------------\n// INCLUDES\n//----------------\nrequire 'a.php';\n" + STATEMENTS
    + "//================\n// [1] Output\n//================\necho $x; // not ?>\n"
    + "<html>\n<body class=\"{\">\n<p>hello</p>\n</body>\n</html>\n<?php\n"
    + "/* Adds\n * one { */\n\nfunction add($a) {\n    return $a + 1;\n}\n\n# end\nadd(1);\n"
)
MODERN = "<?php\nnamespace App;\n\nfunction one() {\n    return 1;\n}\n$a = 1;\n$b = 2;\n$c = 3;\n"
CLASS = "<?php\n\nclass Box {\n    public function run() {\n        return 1;\n    }\n}\n"


def _spans(r: dict) -> list[tuple[int, int]]:
    return [(c["start_line"], c["end_line"]) for c in r["chunks"]]


def _whole(r: dict, text: str) -> None:
    """The chunks are an exact partition of the lines, with their texts."""
    at, lines = 1, text.splitlines()
    for c in r["chunks"]:
        assert c["start_line"] == at
        assert c["text"] == "\n".join(lines[at - 1 : c["end_line"]])
        at = c["end_line"] + 1
    assert at == len(lines) + 1


def test_php_shape():
    judged = lambda text: is_page_script(layout(text), C.BraceChunker(C.PHP).parse("a.php", text).units)
    assert judged(PAGE) and not judged(MODERN) and not judged(CLASS)
    assert judged("<?php\nfunction one() {\n    return 1;\n}\n")
    assert judged("<h1>a</h1>\n<?php $a = 1; ?>\n<h2>b</h2>\n")
    assert not judged("<?php\n$a = 1;\n$b = 2;\n") and judged("<?php\n$a = 1;\n$b = 2;\n$c = 3;\n")
    assert not judged("") and not judged("<?php\n")


def test_page_script():
    r = C.chunk_file("p.php", PAGE, PhpChunker(), 1500)
    _whole(r, PAGE)
    add = next(c for c in r["chunks"] if c["name"] == "add")
    assert add["kind"] == "function" and add["text"].startswith("/* Adds") and add["text"].endswith("}")
    titles = [c["name"] for c in r["chunks"] if c["kind"] in ("module", "html") and c["name"]]
    assert titles == ["INCLUDES", "[1] Output"]
    assert [s["name"] for s in r["symbols"] if s["kind"] == "heading"] == titles
    assert "// INCLUDES" in r["skeleton"] and "function add($a)" in r["skeleton"]
    html = "<?php a(); ?>\n" + "<p>some words of a page</p>\n" * 20 + "<?php b(); ?>\n<i>x</i>\n"
    r = C.chunk_file("h.php", html, PhpChunker(), 1500)
    _whole(r, html)
    assert [c["kind"] for c in r["chunks"]] == ["html"] and "(html)" in r["chunks"][0]["breadcrumb"]


def test_page_script_within_budget():
    text = "<?php\n" + "".join(f"call_{k}('some words');\n" + "\n" * (k % 7 == 0) for k in range(300)) + "function big() {\n" + "    step('x');\n" * 200 + "}\n"
    r = C.chunk_file("p.php", text, PhpChunker(), 600)
    _whole(r, text)
    assert len(r["chunks"]) > 10 and max(C.weight([c["text"]]) for c in r["chunks"]) <= 900
    for text in ("", "\n", "<?php", "plain text", "<?php /* never closed", "<?php $a = 'never closed\n", "<?php\n$t = <<<X\n{ ; }\nX;\nf();\ng();\n", "a\x0cb\n<?php f(); ?>\n<b>\n<?php g(); ?>\n</b>\n"):
        _whole(C.chunk_file("p.php", text, PhpChunker(), 600), text)


def test_modern_php_keeps_its_units():
    for text in (MODERN, CLASS):
        assert _spans(C.chunk_file("m.php", text, PhpChunker())) == _spans(C.chunk_file("m.php", text, C.BraceChunker(C.PHP)))


TABLE = "ROWS = {\n" + "".join(f"    'k{k}': ['red', 'blue', {k}],\n" for k in range(30)) + "}\n\ndef f():\n    return ROWS\n"


def test_python_probes(spark):
    defs = "import os\n\n\ndef f():\n    '''Opens.'''\n\n\nclass G:\n    x = 1\n"
    many = "".join(f"def f{k}(): pass\n" for k in range(150))
    rows = [("t.py", TABLE), ("d.py", defs), ("bad.py", "def ("), ("null.py", None), ("e.py", ""), ("n.txt", "def f(): pass"), ("many.py", many)]
    got = evaluation.python_probes(spark.createDataFrame(rows, "path string, text string")).collect()
    by = {p: sorted((r["lo"], r["hi"], r["question"]) for r in got if r["path"] == p) for p, _ in rows}
    assert len(by["t.py"]) == 30 and by["t.py"][0] == (2, 2, "k0 red blue 0")
    assert by["d.py"] == [(4, 5, "f Opens."), (8, 9, "G")]
    assert len(by["many.py"]) == 60 and not (by["bad.py"] or by["null.py"] or by["e.py"] or by["n.txt"])
    assert evaluation.largest_table("a = {**b, " + ", ".join(f"\n{k}: 1" for k in range(20)) + "}\n")


def test_table_shape(spark):
    chunks = spark.createDataFrame([("t.py", 1, 34, "block"), ("b.py", 1, 34, "block")], "path string, start_line int, end_line int, kind string")
    files = spark.createDataFrame([("t.py", TABLE), ("b.py", "x = 1\n" * 34)], "path string, text string")
    assert {tuple(r) for r in forge.shapes(chunks, 10, files).collect()} == {("t.py", "table"), ("b.py", "blob")}
    assert {r["shape"] for r in forge.shapes(chunks, 10).collect()} == {"blob"}


def test_own_lanes(spark):
    scored = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (1, 1, 0.25)], "qid long, id long, score double")
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "qid long, query string")
    twice = lambda s, q: s.join(q.where("query = 'a'"), "qid").where("id = 2").select("qid", "id", (s["score"] * 0 + 2.0).alias("factor"))
    stray = lambda s, q: spark.createDataFrame([(0, 9, 7.0), (1, 1, None)], "qid long, id long, factor double")
    got = scoring.with_lanes(scored, queries, (twice, stray, twice))
    assert {tuple(r) for r in got.collect()} == {(0, 1, 1.0), (0, 2, 2.0), (1, 1, 0.25)}
    assert scoring.with_lanes(scored, queries, ()) is scored
