"""Queries over a code base made of the parts table: chunkers, symbols, edges, links, grounding, the map, reading, the index.

Each part is a Python, a TypeScript, a Ruby, a Go and a PHP file, and each file uses the one of the next part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import chunkers as C
from tarnwick.operators import corpus as CO
from tarnwick.operators import edges as E
from tarnwick.operators import files as FI
from tarnwick.operators import forge, graph, links
from tarnwick.operators import grep as G
from tarnwick.operators import mapcard as M
from tarnwick.operators import scoring as S
from tarnwick.plans import adapters as A
from tarnwick.plans import indexer
from tarnwick.sources import scratch

PYTHON = 'from m{n} import f{n}\n\nLIMIT_{k} = {k}\n\n\ndef f{k}(x=1):\n    """Doc of {k}."""\n    return f{n}(x)\n\n\nclass K{k}(object):\n    @staticmethod\n    def g():\n        return 1\n'
SOURCES = {
    "src/m{k}.py": PYTHON,
    "web/a{k}.ts": "import {{ x }} from './a{n}.js';\n",
    "lib/r{k}.rb": "require 'r{n}'\n",
    "go/p{k}/a.go": 'package p{k}\n\nimport "example.com/x/go/p{n}"\n\nfunc F{k}() {{ p{n}.F{n}() }}\n',
    "app/C{k}.php": "<?php\nnamespace App;\n\nuse App\\C{n};\n\nclass C{k} {{}}\n",
}
ISSUE = "Crash of part {k} in production\n  File \"src/m{k}.py\", line 7, in f{k}\nsee `f{n}` and lib/r{k}.rb, my_value otherName third_one\n```\nfor x in rows_of_the_table: do_something(x)\n```\n"


def filled(template: str, k: str = "p_partkey") -> Column:
    """The template with the part's number for {k} and the next one for {n}."""
    out = F.lit(template.replace("{{", "{").replace("}}", "}"))
    return F.replace(F.replace(out, F.lit("{k}"), F.col(k).cast("string")), F.lit("{n}"), (F.col(k) + 1).cast("string"))


def filled_sql(template: str) -> str:
    plain = template.replace("{{", "{").replace("}}", "}").replace("'", "''")
    return f"replace(replace('{plain}', '{{k}}', p_partkey::VARCHAR), '{{n}}', (p_partkey + 1)::VARCHAR)"


def code_files(spark, sf_dir: str, only: str = "") -> DataFrame:
    parts = A.spread(A.table(spark, sf_dir, "part").select("p_partkey"))
    made = [F.struct(filled(p).alias("path"), filled(t).alias("text")) for p, t in SOURCES.items() if p.endswith(only)]
    return parts.select(F.explode(F.array(*made)).alias("f")).select("f.path", "f.text")


def python_symbols(spark, sf_dir: str) -> DataFrame:
    return C.children(C.parsed(code_files(spark, sf_dir, ".py")))[2]


def issues(spark, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), filled(ISSUE).alias("query"))


def code_edges(spark, sf_dir: str) -> DataFrame:
    """Edges of all five languages."""
    return E.edges(code_files(spark, sf_dir))


def code_symbols(spark, sf_dir: str) -> DataFrame:
    return python_symbols(spark, sf_dir).select("file", "name", "kind", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "signature", "doc", F.array_join("decorators", ",").alias("decorators"))


def code_skeletons(spark, sf_dir: str) -> DataFrame:
    return C.children(C.parsed(code_files(spark, sf_dir, ".py")))[0].select("path", "skeleton")


def code_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of the Python files with what is embedded of each, by its hash."""
    chunks = C.children(C.parsed(code_files(spark, sf_dir, ".py")))[1]
    return chunks.select("file", "kind", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(T.embed_text(F.col("breadcrumb"), F.col("part"), F.col("text"))).alias("embedded"))


def parsed_documents(spark, sf_dir: str) -> DataFrame:
    """Whole documents through the chunkers of five languages: hash, lines, and how many lines the chunks cover."""
    f = A.files(spark, sf_dir).select(F.regexp_replace("path", "[.]md$", F.element_at(F.lit([".md", ".py", ".ts", ".rb", ".go"]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"), "text")
    size = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["end_line"] - c["start_line"] + 1)
    return C.parsed(f).select("path", "sha", F.col("total_lines").cast("long").alias("lines"), size.alias("covered"))


def chunk_contract(spark, sf_dir: str) -> DataFrame:
    """Violations of the line partition by the chunkers of five languages over whole documents: none."""
    f = A.files(spark, sf_dir).select(F.regexp_replace("path", "[.]md$", F.element_at(F.lit([".md", ".py", ".ts", ".rb", ".go"]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"), T.normalised("text").alias("text"))
    chunks = C.parsed(f, budget=400).select("path", F.inline("chunks")).select("path", "start_line", "end_line")
    return CO.partition_violations(chunks, f)


def use_sites(spark, sf_dir: str) -> DataFrame:
    return links.use_sites(code_files(spark, sf_dir, ".py")).select("src", F.col("line").cast("long").alias("line"), "name", "dst", "said")


def file_links(spark, sf_dir: str) -> DataFrame:
    hit = links.file_links(links.use_sites(code_files(spark, sf_dir, ".py")), python_symbols(spark, sf_dir))
    return hit.select("src", F.col("line").cast("long").alias("line"), "name", "dst", F.col("at").cast("long").alias("at"))


def hop_symbols(spark, sf_dir: str) -> DataFrame:
    return links.hop_symbols(links.use_sites(code_files(spark, sf_dir, ".py"))).select("src", "dst", "name", F.col("sure").cast("long").alias("sure"), "n", F.col("line").cast("long").alias("line"))


def inferred_sites(spark, sf_dir: str) -> DataFrame:
    lines = CO.line_table(code_files(spark, sf_dir, ".py")).withColumnRenamed("path", "file")
    pairs = E.edges(code_files(spark, sf_dir, ".py")).select("src", "dst").distinct()
    return links.inferred_sites(lines, python_symbols(spark, sf_dir), pairs).select("src", F.col("line").cast("long").alias("line"), "name", "dst")


def query_variants(spark, sf_dir: str) -> DataFrame:
    return S.query_variants(issues(spark, sf_dir))


def issue_pins(spark, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir).select("path")
    pins = S.grounded(issues(spark, sf_dir), files, python_symbols(spark, sf_dir))
    return pins.select("qid", "file", F.col("tier").cast("long").alias("tier"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def issue_apply(spark, sf_dir: str) -> DataFrame:
    """A chunk of the file that crashed, of the one that is named, and of a test, all with score 0.5."""
    made = [F.struct(F.lit(i).alias("id"), filled(p).alias("file")) for i, p in enumerate(("src/m{k}.py", "src/m{n}.py", "tests/t{k}.py"))]
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.explode(F.array(*made)).alias("c")).select("qid", "c.*", F.lit(1).alias("start_line"), F.lit(14).alias("end_line"), F.lit(0.5).alias("score"))
    pins = S.grounded(issues(spark, sf_dir), code_files(spark, sf_dir).select("path"), python_symbols(spark, sf_dir))
    return S.apply_issue(rows, pins).select("qid", "file", F.round("score", 6).alias("score"))


def find_symbols(spark, sf_dir: str) -> DataFrame:
    return G.find_symbols(python_symbols(spark, sf_dir), "g").select("file", "name")


def map_outline(spark, sf_dir: str) -> DataFrame:
    spans = code_files(spark, sf_dir, ".py").select(F.lit(1).cast("long").alias("qid"), F.col("path").alias("file"), F.lit(5).alias("lo"), F.lit(12).alias("hi"))
    return M.outline(spans, python_symbols(spark, sf_dir)).select("qid", "file", "name", F.col("line").cast("long").alias("line"), F.col("overlap").cast("long").alias("overlap"))


def map_defines(spark, sf_dir: str) -> DataFrame:
    q = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), filled("where is LIMIT_{k} set and why").alias("query"))
    return M.defines(q, python_symbols(spark, sf_dir)).select("qid", "said", "file", F.col("line").cast("long").alias("line"))


def map_links(spark, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return M.links(E.edges(files), files.select(F.col("path").alias("file")))


def map_trail(spark, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), filled("f{k}").alias("said"))
    lines = CO.line_table(code_files(spark, sf_dir, ".py")).withColumnRenamed("path", "file")
    return M.trail(names, lines, python_symbols(spark, sf_dir)).select("qid", "said", "file", F.col("line").cast("long").alias("line"), "kind")


SPECS = ["src/m1.py", "src/m2.py#f2,K2.g", "src/m3.py:2-4", "nope.py", "src/m4.py#zzz"]


def read_specs(spark, sf_dir: str) -> DataFrame:
    rows = FI.read_specs(spark, code_files(spark, sf_dir, ".py"), python_symbols(spark, sf_dir), SPECS)
    cast = lambda c: F.when(F.col("status") == "ok", F.col(c)).cast("long").alias(c)
    return rows.select(F.col("seq").cast("long").alias("seq"), F.col("sub").cast("long").alias("sub"), "path", cast("lo"), cast("hi"), "status")


def file_shapes(spark, sf_dir: str) -> DataFrame:
    chunks = C.children(C.parsed(code_files(spark, sf_dir, ".py")))[1].withColumnRenamed("file", "path")
    return forge.shapes(chunks, 10)


def graph_path(spark, sf_dir: str) -> DataFrame:
    path = graph.shortest_path(E.edges(code_files(spark, sf_dir, ".py")), None, "src/m1.py", "src/m4.py")
    return spark.createDataFrame(list(enumerate(path)), "place long, file string")


def resolve_node(spark, sf_dir: str) -> DataFrame:
    return graph.resolve_node(code_files(spark, sf_dir), "m7.py")


def store_stats(spark, sf_dir: str) -> DataFrame:
    """The whole code base indexed: chunked, embedded, linked and stored; rows of each relation."""
    root = scratch.folder(spark)
    indexer.index(spark, code_files(spark, sf_dir), root)
    return indexer.Store(spark, root).stats()


def index_pass(spark, sf_dir: str) -> DataFrame:
    """What a second pass of the index does: files that came, changed, stayed and went."""
    root, k = scratch.folder(spark), F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    files = code_files(spark, sf_dir, ".ts")
    indexer.index(spark, files.where(k % 10 != 0), root)
    counts = indexer.index(spark, files.where(k % 11 != 0).withColumn("text", F.when(k % 7 == 0, F.concat("text", F.lit("// more\n"))).otherwise(F.col("text"))), root)
    return spark.createDataFrame(sorted(counts.items()), "change string, n long")


QUERIES = {f.__name__: f for f in (
    code_edges, code_symbols, code_skeletons, code_chunks, parsed_documents, chunk_contract, use_sites, file_links, hop_symbols, inferred_sites, query_variants, issue_pins, issue_apply,
    find_symbols, map_outline, map_defines, map_links, map_trail, read_specs, file_shapes, graph_path, resolve_node, store_stats, index_pass)}

NEXT = "p AS (SELECT p_partkey AS k, p_partkey + 1 AS n FROM part), two AS (SELECT k, n FROM p WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = n))"
EDGES = f"""{NEXT}, edge AS (SELECT 'src/m' || k || '.py' AS src, 'src/m' || n || '.py' AS dst, kind FROM two, (VALUES ('import'), ('call')) AS v(kind)
  UNION ALL SELECT 'web/a' || k || '.ts', 'web/a' || n || '.ts', 'import' FROM two UNION ALL SELECT 'lib/r' || k || '.rb', 'lib/r' || n || '.rb', 'import' FROM two
  UNION ALL SELECT 'go/p' || k || '/a.go', 'go/p' || n || '/a.go', 'import' FROM two UNION ALL SELECT 'app/C' || k || '.php', 'app/C' || n || '.php', 'import' FROM two)"""
SYMBOLS = f"""{NEXT}, symbol AS (SELECT k, 'src/m' || k || '.py' AS file, replace(name, '#', k::VARCHAR) AS name, kind, line::BIGINT AS line, end_line::BIGINT AS end_line, replace(signature, '#', k::VARCHAR) AS signature, replace(doc, '#', k::VARCHAR) AS doc, decorators
  FROM p, (VALUES ('LIMIT_#', 'constant', 3, 3, 'LIMIT_#', '', ''), ('f#', 'function', 6, 8, 'def f#(x=1)', 'Doc of #.', ''), ('K#', 'class', 11, 14, 'class K#(object)', '', ''), ('K#.g', 'method', 12, 14, 'def g()', '', 'staticmethod')) AS v(name, kind, line, end_line, signature, doc, decorators))"""
SITES = f"{NEXT}, site AS (SELECT 'src/m' || k || '.py' AS src, line::BIGINT AS line, 'f' || n AS name, 'src/m' || n || '.py' AS dst, said FROM two, (VALUES (1, 'import'), (8, 'call')) AS v(line, said))"
LANGUAGE = "replace(path, '.md', CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' WHEN 3 THEN '.rb' ELSE '.go' END)"
from tarnwick.plans.lexical import LINES  # noqa: E402

ORACLES = {
    "code_edges": f"WITH {EDGES} SELECT src, dst, kind FROM edge",
    "code_symbols": f"WITH {SYMBOLS} SELECT file, name, kind, line, end_line, signature, doc, decorators FROM symbol",
    "code_skeletons": f"SELECT {filled_sql('src/m{k}.py')} AS path, " + filled_sql("# src/m{k}.py\nLIMIT_{k}\ndef f{k}(x=1)  # Doc of {k}.\nclass K{k}(object)\n    def g()") + " AS skeleton FROM part",
    "code_chunks": f"SELECT {filled_sql('src/m{k}.py')} AS file, 'block' AS kind, {filled_sql('f{k}, K{k}')} AS name, 1::BIGINT AS start_line, 14::BIGINT AS end_line, md5({filled_sql('# src/m{k}.py > f{k}, K{k}' + chr(10) + PYTHON.rstrip(chr(10)))}) AS embedded FROM part",
    "parsed_documents": f"""SELECT {LANGUAGE} AS path, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha, coalesce(n, 0) AS lines, coalesce(n, 0) AS covered
      FROM ({A.FILE_SQL}) LEFT JOIN (SELECT path, count(*) AS n FROM ({LINES}) GROUP BY path) USING (path)""",
    "chunk_contract": "SELECT '' AS path, '' AS reason WHERE false",
    "use_sites": f"WITH {SITES} SELECT * FROM site",
    "file_links": f"WITH {SITES} SELECT src, line, name, dst, 6::BIGINT AS at FROM site",
    "hop_symbols": f"WITH {SITES} SELECT src, dst, name, 1::BIGINT AS sure, count(*) AS n, min(line) AS line FROM site GROUP BY ALL",
    "inferred_sites": f"WITH {SITES} SELECT src, line, name, dst FROM site UNION ALL SELECT src, line, 'g', dst FROM site JOIN (VALUES (13::BIGINT)) AS v(line) USING (line)" + f" UNION ALL SELECT 'src/m' || k || '.py', 13, 'g', 'src/m' || n || '.py' FROM two",
    "query_variants": "SELECT p_partkey AS qid, kind, variant FROM (SELECT p_partkey, unnest(['title', 'frames', 'code', 'identifiers']) AS kind, unnest(["
      + ", ".join(filled_sql(x) for x in ("Crash of part {k} in production", '  File "src/m{k}.py", line 7, in f{k}', "for x in rows_of_the_table: do_something(x)\n", "do_something my_value otherName rows_of_the_table third_one")) + "]) AS variant FROM part)",
    "issue_pins": f"""WITH {NEXT} SELECT k AS qid, 'src/m' || k || '.py' AS file, 0::BIGINT AS tier, 6::BIGINT AS lo, 8::BIGINT AS hi FROM p UNION ALL SELECT k, 'src/m' || k || '.py', 1, NULL, NULL FROM p
      UNION ALL SELECT k, 'lib/r' || k || '.rb', 1, NULL, NULL FROM p UNION ALL SELECT k, 'src/m' || n || '.py', 2, 6, 8 FROM two WHERE length('f' || n) >= 3""",
    "issue_apply": f"""WITH {NEXT} SELECT k AS qid, 'src/m' || k || '.py' AS file, 1.25::DOUBLE AS score FROM p UNION ALL SELECT k, 'src/m' || n || '.py', CASE WHEN length('f' || n) >= 3 AND EXISTS (SELECT 1 FROM two WHERE two.k = p.k) THEN 0.75 ELSE 0.5 END FROM p
      UNION ALL SELECT k, 'tests/t' || k || '.py', -1 FROM p""",
    "find_symbols": f"WITH {SYMBOLS} SELECT file, name FROM symbol WHERE name = 'g' OR name LIKE '%.g'",
    "map_outline": f"WITH {SYMBOLS} SELECT 1::BIGINT AS qid, file, name, line, least(12, end_line) - greatest(5, line) + 1 AS overlap FROM symbol WHERE line <= 12 AND end_line >= 5",
    "map_defines": f"WITH {SYMBOLS} SELECT k AS qid, name AS said, file, line FROM symbol WHERE kind = 'constant'",
    "map_links": f"WITH {EDGES} SELECT DISTINCT dst AS file, 'reached_from' AS way, src AS other FROM edge UNION ALL SELECT DISTINCT src, 'reaches', dst FROM edge",
    "map_trail": f"WITH {SITES} SELECT k AS qid, 'f' || k AS said, 'src/m' || k || '.py' AS file, 6::BIGINT AS line, 'defines' AS kind FROM p UNION ALL SELECT n, name, src, line, 'reads' FROM site JOIN two ON name = 'f' || n",
    "read_specs": """SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'src/m1.py', 1::BIGINT, 14::BIGINT, 'ok'), (1, 0, 'src/m2.py', 6, 8, 'ok'), (1, 1, 'src/m2.py', 12, 14, 'ok'), (2, 0, 'src/m3.py', 2, 4, 'ok'), (3, 0, 'nope.py', NULL, NULL, 'missing'), (4, 0, 'src/m4.py', NULL, NULL, 'missing')) AS v(seq, sub, path, lo, hi, status)""",
    "file_shapes": f"SELECT {filled_sql('src/m{k}.py')} AS path, 'blob' AS shape FROM part",
    "graph_path": "SELECT i AS place, 'src/m' || (i + 1) || '.py' AS file FROM (SELECT unnest(range(0, 4)) AS i)",
    "resolve_node": "SELECT 'src/m7.py' AS path",
    "store_stats": f"WITH {EDGES}, {SYMBOLS.split('), ', 2)[2]} SELECT relation, rows FROM (SELECT 'files' AS relation, 5 * count(*) AS rows FROM p UNION ALL SELECT 'chunks', 5 * count(*) FROM p UNION ALL SELECT 'symbols', (SELECT count(*) FROM symbol) + 2 * (SELECT count(*) FROM p) UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'flows', 0 UNION ALL SELECT 'meta', 3)",
    "index_pass": """SELECT change, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 AND p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'orphan' WHEN p_partkey % 10 = 0 THEN 'new' WHEN p_partkey % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM part) WHERE change IS NOT NULL GROUP BY change""",
}
