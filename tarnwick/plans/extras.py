"""Queries of the corpus rules, scalar functions, the flow cache, reranking, evaluation and the store's row operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import vectors as V
from tarnwick.operators import ask as AS
from tarnwick.operators import bundle as B
from tarnwick.operators import corpus as C
from tarnwick.operators import evaluation as EV
from tarnwick.operators import flows as FL
from tarnwick.operators import mapcard as M
from tarnwick.operators import related as RE
from tarnwick.operators import rerank as R
from tarnwick.operators import scoring as S
from tarnwick.params import DEFAULTS
from tarnwick.plans import adapters as A
from tarnwick.plans.retrieval import BUNDLE, CORE, RANKED, SCORED, assembled, bundle, shortlist
from tarnwick.sources import store
from tarnwick.sources.embed import HashEmbedder, embedded

# --- corpus rules -----------------------------------------------------------------------------------------------------
IGNORE = "*.log\n!keep.log\n/build/\ndocs/**/*.tmp\n# a remark\n\nsrc/[ab]?.py\n"


def paths(spark, sf_dir: str) -> DataFrame:
    """A path a part, of ten kinds."""
    made = ["x{k}.log", "a/keep.log", "build/{k}.o", "docs/a/b{k}.tmp", "src/a1.py", "src/c{k}.py", "node_modules/x{k}.js", "lib/jquery-{k}.min.js", "api/v{k}_pb2.py", "packages/p{k}/i.ts"]
    one = F.element_at(F.lit(made), (F.col("p_partkey") % 10 + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace(one, F.lit("{k}"), F.col("p_partkey").cast("string")).alias("path"))


def gitignore_last_match(spark, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("k", C.gitignored(F.col("path"), C.parse_gitignore(IGNORE)).alias("ignored"))


def vendored_flag(spark, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("k", C.is_vendored(F.col("path")).alias("vendored"), C.is_vendored(F.col("path"), True).alias("in_workspace"))


def split_patterns(spark, sf_dir: str) -> DataFrame:
    """Paths left out by a bare name, a glob and a folder."""
    return paths(spark, sf_dir).select("k", C.excluded(F.col("path"), ["api", "docs/*", "src/c*.py"]).alias("excluded"))


def ignore_lines(spark, sf_dir: str) -> DataFrame:
    """Patterns of ignore files: every document read as one."""
    return C.ignore_patterns(A.files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("pattern")).alias("chars"))


def generated_flag(spark, sf_dir: str) -> DataFrame:
    """By whole texts, and by name for every fifth path."""
    f = A.files(spark, sf_dir)
    path = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("path", "[.]md$", ".pb.go")).otherwise(F.col("path"))
    return f.select("doc_id", C.is_generated(path, F.col("text")).alias("generated"))


def uncovered_ext(spark, sf_dir: str) -> DataFrame:
    f = A.files(spark, sf_dir).withColumn("path", F.regexp_replace("path", "md$", F.element_at(F.lit(["md", "toml", "lua"]), (F.col("doc_id") % 3 + 1).cast("int"))))
    return C.uncovered(f, ["md"]).select("ext", "files", "smallest", "largest")


def discover(spark, sf_dir: str) -> DataFrame:
    """What the index takes of the whole corpus."""
    f = A.files(spark, sf_dir).withColumn("path", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("build/"), "path")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("notes/"), F.regexp_replace("path", "md$", "log"))).otherwise(F.col("path")))
    return C.discover(f, ["md", "log"], rules=C.parse_gitignore(IGNORE)).select("path")


# --- scalar functions ---------------------------------------------------------------------------------------------------
def path_facts(spark, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf_dir).select("k", T.extension(p).alias("ext"), T.stem(p).alias("stem"), T.top_dir(p).alias("dir"), T.lang_of(p).alias("lang"), T.is_test_path(F.concat(F.lit("Tests/"), p)).alias("test"), T.is_demo_path(F.concat(F.lit("x/Examples/"), p)).alias("demo"), T.is_test_path(p).alias("plain"), T.under_path(p, "/src/").alias("under"))


def norm_rel(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    made = F.concat(F.lit("./a/"), k, F.lit("/../b/./"), k, F.lit("//c.py"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.norm_rel(made).alias("path"), T.norm_rel(F.concat(F.lit("a/../../"), k)).alias("outside"))


def cache_keys(spark, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "benchmark").select("item_id", T.cache_key("m", F.col("text")).alias("key"))


def hashed_embedding(spark, sf_dir: str) -> DataFrame:
    """The deterministic embedder over benchmark items, as an expression: numbers that aren't zero."""
    b = A.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.hashed_embedding(F.col("text"))).alias("bucket", "v"))
    return b.where("v <> 0").select("item_id", F.col("bucket").cast("long").alias("bucket"), F.round("v", 6).alias("v"))


def embed_cache_miss(spark, sf_dir: str) -> DataFrame:
    """Vectors of items, those of every other one from a cache (there all -1); the rest by the embedder over Arrow."""
    items = A.table(spark, sf_dir, "benchmark").select("item_id", "text")
    hasher = HashEmbedder()
    cache = items.where("item_id % 2 = 0").select(T.cache_key(hasher.name, F.col("text")).alias("key"), F.array_repeat(F.lit(-1.0).cast("float"), hasher.dims).alias("vec"))
    return embedded(items, hasher, cache=cache).select("item_id", (F.element_at("vec", 1) == -1).alias("cached"), F.round(F.sqrt(V.dot(F.col("vec"), F.col("vec"))), 4).alias("length"))


def snippets(spark, sf_dir: str) -> DataFrame:
    """Slug and snippet of whole documents as pages."""
    return A.files(spark, sf_dir).select("path", T.slug("path").alias("slug"), T.snippet("text").alias("snippet"))


ANSWER = "Part {k} is read here [[1:10-20,L25]] and [[2]].\n\n\n\n```py\nx = {k}\n```\nDone [[3: {k} - {k}]]."


def _answers(spark, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.replace(F.lit(ANSWER), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("text"))


def strip_code(spark, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("k", T.strip_code("text").alias("prose"))


def citation_ranges(spark, sf_dir: str) -> DataFrame:
    """Citations of an answer, each with its ranges."""
    said = _answers(spark, sf_dir).select("k", F.posexplode(T.citations("text")).alias("place", "spec"))
    rows = said.select("k", "place", F.explode_outer(T.parse_ranges("spec")).alias("r"))
    return rows.select("k", F.col("place").cast("long").alias("place"), F.col("r.lo").cast("long").alias("lo"), F.col("r.hi").cast("long").alias("hi"))


def reexports(spark, sf_dir: str) -> DataFrame:
    """Files of as many imports as the part's size and five other lines."""
    text = F.concat(F.repeat(F.lit("import x\n\n"), F.col("p_size").cast("int")), F.repeat(F.lit("y = 1\n"), F.lit(5)))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), R.is_reexport(text).alias("reexport"))


def hints(spark, sf_dir: str) -> DataFrame:
    """The line of a text that shares most with a query."""
    text = F.concat_ws("\n", F.lit("nothing here"), F.lit("  size_of_item"), F.concat(F.lit("def item_named_"), F.lower(F.regexp_replace("p_type", " ", "_"))), F.lit("item"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), R.hint(text, F.concat(F.lit("the item named "), F.lower("p_type"))).alias("line"))


# --- search and map -----------------------------------------------------------------------------------------------------
def docs_side(spark, sf_dir: str) -> DataFrame:
    """Documents alone, code alone, and a side that isn't there: all rows."""
    p = paths(spark, sf_dir).withColumn("path", F.when(F.col("k") % 3 == 0, F.concat("path", F.lit(".md"))).otherwise(F.col("path")))
    code = p.where("k % 3 <> 0")
    count = lambda df, n: df.agg(F.lit(n).alias("side"), F.count("*").alias("n"))
    return count(S.side_filter(p, True, "path"), "docs").unionByName(count(S.side_filter(p, False, "path"), "code")).unionByName(count(S.side_filter(code, True, "path"), "open"))


def pruned_parts(spark, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.lit(["examples/", "tests/", "src/", "src/", "src/"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).cast("long").alias("qid"), F.concat(folder, F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), F.col("p_retailprice").cast("double").alias("score"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + 9).cast("long").alias("end_line"))


def map_files(spark, sf_dir: str) -> DataFrame:
    return M.head_and_tail(pruned_parts(spark, sf_dir))


def related_docs(spark, sf_dir: str) -> DataFrame:
    return RE.related_docs(pruned_parts(spark, sf_dir))


def pinning_tests(spark, sf_dir: str) -> DataFrame:
    """Test files that name parts of the query's size."""
    p = A.table(spark, sf_dir, "part")
    chunks = p.select(F.concat(F.lit("tests/test_n"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), F.concat(F.lit("n"), F.col("p_partkey").cast("string"), F.lit(" n"), (F.col("p_partkey") + 1).cast("string")).alias("text"))
    names = p.select(F.col("p_size").cast("long").alias("qid"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    return RE.pinning_tests(chunks, names)


def docsearch_hits(spark, sf_dir: str) -> DataFrame:
    """Documents as pages of five searches, scored by their length."""
    d = A.files(spark, sf_dir).select((F.col("doc_id") % 5).alias("qid"), "path", F.concat(F.lit("Top > Doc "), F.col("doc_id").cast("string")).alias("breadcrumb"), "text", (F.col("doc_id") * 7919 % 1009 + 1).cast("double").alias("score"))
    return B.docsearch(d, [("src0", "First"), ("src", "Other")]).select("qid", "slug", "pct", "title", "grp")


def classify_broad(spark, sf_dir: str) -> DataFrame:
    q = A.queries(spark, sf_dir).select("qid", F.lit("how does it work").alias("query"))
    return B.classify(bundle(spark, sf_dir), q)


def ask_candidates(spark, sf_dir: str) -> DataFrame:
    """Numbered candidates of each search, texts until the budget is spent."""
    chosen = B.selection(*assembled(spark, sf_dir, DEFAULTS.chunk_cap)).select("qid", "id", "file", "score", "role", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.repeat(F.lit("x"), F.lit(100)).alias("text"))
    return AS.candidates(chosen, 1050).select("qid", "id", F.col("k").cast("long").alias("k"), F.col("text").isNotNull().alias("whole"))


def agent_plan(spark, sf_dir: str) -> DataFrame:
    """Bundle files by directory: work for agents."""
    return AS.plan_by_directory(bundle(spark, sf_dir)).select("qid", F.col("agent").cast("long").alias("agent"), F.array_join("files", ",").alias("files"))


def rerank_setaside(spark, sf_dir: str) -> DataFrame:
    """Dropped chunks worth a look, where the judge keeps every third id."""
    ranked = shortlist(spark, sf_dir, of_all=40).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))).where("rank <= 40")
    return R.set_aside(ranked, ranked.where("id % 3 = 0")).select("qid", "id", "file", "score")


# --- flows ----------------------------------------------------------------------------------------------------------------
def _flows(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows that cite one document each, by its hash, every third by an older one; and the files."""
    f = A.flows(spark, sf_dir).withColumn("path", F.concat(F.lit("d/"), (F.col("id") % 50).cast("string")))
    files = spark.range(50).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.md5(F.col("id").cast("string")).alias("sha"))
    was = F.when(F.col("id") % 3 == 0, F.lit("older")).otherwise(F.md5((F.col("id") % 50).cast("string")))
    return f.withColumns({"files": F.create_map("path", was), "created": F.col("id").cast("double")}), files


def flow_stale(spark, sf_dir: str) -> DataFrame:
    return FL.stale(*_flows(spark, sf_dir))


def flow_prune(spark, sf_dir: str) -> DataFrame:
    return FL.prune_stale(*_flows(spark, sf_dir)).select("id")


def flow_listing(spark, sf_dir: str) -> DataFrame:
    return FL.listing(*_flows(spark, sf_dir)).select("id", "created", "stale")


def flow_serve(spark, sf_dir: str) -> DataFrame:
    """Flows asked again in their own words, by their own vectors."""
    flows, files = _flows(spark, sf_dir)
    return FL.serve(flows, flows.select(F.col("id").alias("qid"), "qvec", F.col("question").alias("query")), files)


def flow_lane(spark, sf_dir: str) -> DataFrame:
    """Files that the flows of a search cite, as related files of its bundle."""
    flows, _ = _flows(spark, sf_dir)
    return FL.flow_lane(bundle(spark, sf_dir), FL.match_flows(flows, A.queries(spark, sf_dir)), flows)


# --- evaluation -----------------------------------------------------------------------------------------------------------
def _probes(spark, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("f"), (F.col("p_partkey") % 40).cast("string")).alias("path"), F.col("p_size").alias("lo"), (F.col("p_size") + 9).alias("hi"))


def _ranked(spark, sf_dir: str, height: int) -> DataFrame:
    """Windows of so many lines of the probe's file and ranks of no meaning."""
    w = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("f"), (F.col("p_partkey") % 40).cast("string")).alias("path"), F.explode(F.sequence(F.lit(0), F.lit(60 // height))).alias("i"))
    return w.select("qid", "path", F.col("i").alias("id"), (F.col("i") * height + 1).alias("start_line"), ((F.col("i") + 1) * height).alias("end_line"), (F.pmod(F.col("i") * 5 + F.col("qid"), F.lit(60 // height + 1)) + 1).cast("int").alias("rank"))


def span_iou(spark, sf_dir: str) -> DataFrame:
    m = EV.measure(_probes(spark, sf_dir), _ranked(spark, sf_dir, 12))
    return m.select("qid", "path", F.round("iou", 6).alias("iou"), F.col("hit1").cast("long").alias("hit1"), F.col("hit5").cast("long").alias("hit5"))


def ab_verdict(spark, sf_dir: str) -> DataFrame:
    a, b = (EV.measure(_probes(spark, sf_dir), _ranked(spark, sf_dir, h)) for h in (30, 12))
    g = EV.ab_gate(a, b)
    return g.select(F.round("iou_a", 6).alias("iou_a"), F.round("iou_b", 6).alias("iou_b"), "hit_a", "hit_b", F.round("worst", 6).alias("worst"), "win")


def _spans(spark, sf_dir: str, odd: int) -> DataFrame:
    """Two chunks a path; of every seventh path the second begins elsewhere."""
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.explode(F.lit([1, 2])).alias("i"))
    cut = F.when(F.col("k") % 7 == 0, 10 + odd).otherwise(10)
    return p.select("path", F.when(F.col("i") == 1, 1).otherwise(cut + 1).alias("start_line"), F.when(F.col("i") == 1, cut).otherwise(30).alias("end_line"), (F.when((F.col("k") % 5 == 0) & F.lit(odd > 0), 20).otherwise(90) + F.col("i")).alias("nws"))


def changed_files(spark, sf_dir: str) -> DataFrame:
    return EV.changed_files(_spans(spark, sf_dir, 0), _spans(spark, sf_dir, 3))


def too_fine(spark, sf_dir: str) -> DataFrame:
    return EV.too_fine(_spans(spark, sf_dir, 3), _spans(spark, sf_dir, 0))


# --- rows of the store ------------------------------------------------------------------------------------------------------
def replace_edges(spark, sf_dir: str) -> DataFrame:
    """Suppliers 1 to 5 indexed again with an edge each to part 1, suppliers 6 and 7 and part 2 gone."""
    old = A.supply_edges(spark, sf_dir)
    again = spark.range(1, 6).select(F.concat(F.lit("supplier/"), F.col("id").cast("string")).alias("path"))
    gone = spark.createDataFrame([("supplier/6",), ("supplier/7",), ("part/2",)], "path string")
    return store.replace_edges(old, again.select(F.col("path").alias("src"), F.lit("part/1").alias("dst"), F.lit("new").alias("kind")), again, gone)


def replace_rows(spark, sf_dir: str) -> DataFrame:
    """Symbols of a part's file, those of every fourth file replaced by one."""
    p = A.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"), F.explode(F.split("p_name", " ")).alias("name"))
    again = A.table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"))
    return store.replace_rows(p, again.select(F.col("path").alias("file"), F.lit("new").alias("name")), again)


QUERIES = {f.__name__: f for f in (
    gitignore_last_match, vendored_flag, split_patterns, ignore_lines, generated_flag, uncovered_ext, discover, path_facts, norm_rel, cache_keys, hashed_embedding, embed_cache_miss, snippets,
    strip_code, citation_ranges, reexports, hints, docs_side, map_files, related_docs, pinning_tests, docsearch_hits, classify_broad, ask_candidates, agent_plan, rerank_setaside,
    flow_stale, flow_prune, flow_listing, flow_serve, flow_lane, span_iou, ab_verdict, changed_files, too_fine, replace_edges, replace_rows)}

KIND = "p_partkey % 10"
PATHS = f"path AS (SELECT p_partkey AS k, {KIND} AS kind, replace(['x{{k}}.log', 'a/keep.log', 'build/{{k}}.o', 'docs/a/b{{k}}.tmp', 'src/a1.py', 'src/c{{k}}.py', 'node_modules/x{{k}}.js', 'lib/jquery-{{k}}.min.js', 'api/v{{k}}_pb2.py', 'packages/p{{k}}/i.ts'][kind + 1], '{{k}}', p_partkey::VARCHAR) AS path FROM part)"
PARTS = "pruned AS (SELECT p_partkey % 7 AS qid, ['examples/', 'tests/', 'src/', 'src/', 'src/'][p_partkey % 5 + 1] || 'f' || p_partkey || '.py' AS file, p_retailprice::DOUBLE AS score, p_size::BIGINT AS start_line, p_size::BIGINT + 9 AS end_line, p_partkey % 5 AS m FROM part)"
FLOWS = f"f AS ({A.FLOW_SQL}), c AS (SELECT *, 'd/' || (id % 50) AS path, id % 3 <> 0 AS current FROM f)"
SIM = "round((list_inner_product(a.vec, b.vec) + 1) / 2, 6)"
MEASURE = """probe AS (SELECT p_partkey AS qid, 'f' || (p_partkey % 40) AS path, p_size AS lo, p_size + 9 AS hi FROM part),
chunk AS (SELECT qid, path, lo, hi, h, i * h + 1 AS s, (i + 1) * h AS e, (i * 5 + qid) % (60 // h + 1) + 1 AS rank FROM probe, (VALUES (12), (30)) AS v(h), LATERAL (SELECT unnest(range(0, 60 // h + 1)) AS i)),
cut AS (SELECT *, greatest(least(hi, e) - greatest(lo, s) + 1, 0) AS o, greatest(hi, e) - least(lo, s) + 1 AS hull FROM chunk),
own AS (SELECT h, qid, path, arg_min(o / hull, rank) AS iou, max(CASE WHEN o > 0 AND rank <= 1 THEN 1 ELSE 0 END) AS hit1, max(CASE WHEN o > 0 AND rank <= 5 THEN 1 ELSE 0 END) AS hit5 FROM cut GROUP BY h, qid, path)"""
MARK = C.GENERATED_MARKS.replace("'", "''")

ORACLES = {
    "gitignore_last_match": f"WITH {PATHS} SELECT k, kind IN (0, 2, 3, 4) AS ignored FROM path",
    "vendored_flag": f"WITH {PATHS} SELECT k, kind IN (2, 6, 7, 9) AS vendored, kind IN (2, 6, 7) AS in_workspace FROM path",
    "split_patterns": f"WITH {PATHS} SELECT k, kind IN (2, 3, 5, 6, 8) AS excluded FROM path",
    "ignore_lines": r"""WITH l AS (SELECT path, trim(split_part(text, '#', 1)) AS pattern FROM (%s)) SELECT path, count(*) AS n, CAST(sum(length(pattern)) AS BIGINT) AS chars FROM l WHERE pattern <> '' GROUP BY path""",
    "generated_flag": f"""WITH h AS (SELECT doc_id, substring(text, 1, 2048) AS head FROM documents), b AS (SELECT *, length(head) - length(replace(head, chr(10), '')) AS breaks FROM h)
      SELECT doc_id, doc_id % 5 = 0 OR regexp_matches(head, '(?i){MARK}') OR (length(head) >= 2000 AND breaks <= 2) OR (breaks > 0 AND length(head) / (breaks + 1) > 400) AS generated FROM b""",
    "uncovered_ext": f"""WITH f AS (SELECT ['md', 'toml', 'lua'][doc_id % 3 + 1] AS ext, replace(path, '.md', '.' || ['md', 'toml', 'lua'][doc_id % 3 + 1]) AS path, strlen(text) AS b FROM ({A.FILE_SQL}))
      SELECT ext, count(*) AS files, arg_min(path, {{'b': b, 'p': path}}) AS smallest, arg_max(path, {{'b': b, 'p': path}}) AS largest FROM f WHERE ext <> 'md' GROUP BY ext HAVING count(*) >= 2""",
    "discover": f"""WITH f AS (SELECT CASE doc_id % 4 WHEN 1 THEN 'build/' || path WHEN 2 THEN 'notes/' || replace(path, '.md', '.log') ELSE path END AS path, doc_id, text, substring(text, 1, 2048) AS head FROM ({A.FILE_SQL})), b AS (SELECT *, length(head) - length(replace(head, chr(10), '')) AS breaks FROM f)
      SELECT path FROM b WHERE doc_id % 4 NOT IN (1, 2) AND NOT (regexp_matches(head, '(?i){MARK}') OR (length(head) >= 2000 AND breaks <= 2) OR (breaks > 0 AND length(head) / (breaks + 1) > 400)) AND strlen(text) <= 600000""",
    "path_facts": f"""WITH {PATHS}, b AS (SELECT k, path, kind, regexp_extract(path, '[^/]*$') AS leaf FROM path)
      SELECT k, regexp_extract(path, '\\.([^./]+)$', 1) AS ext, regexp_replace(leaf, '\\.[^.]*$', '') AS stem, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS dir,
        CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE '' END AS lang, true AS test, true AS demo, false AS plain, starts_with(path, 'src/') AS under FROM b""",
    "norm_rel": "SELECT p_partkey AS k, 'a/b/' || p_partkey || '/c.py' AS path, CAST(NULL AS VARCHAR) AS outside FROM part",
    "cache_keys": "SELECT item_id, sha1('m' || chr(0) || text) AS key FROM benchmark",
    "hashed_embedding": """WITH c AS (SELECT item_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS t FROM benchmark) GROUP BY ALL)
      SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS v FROM c""",
    "embed_cache_miss": "SELECT item_id, item_id % 2 = 0 AS cached, CASE WHEN item_id % 2 = 0 THEN 16.0::DOUBLE ELSE 1.0 END AS length FROM benchmark",
    "snippets": r"""WITH a AS (SELECT path, regexp_replace(regexp_replace(text, '(?s)^---\n.*?\n---\n', ''), '(?m)^#[^\n\r]*$', '', 'g') AS t FROM (%s)),
      b AS (SELECT path, trim(regexp_replace(regexp_replace(regexp_replace(t, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[`*_]+', '', 'g'), '[\s\x0B]+', ' ', 'g')) AS t FROM a)
      SELECT path, replace(path, '.md', '') AS slug, CASE WHEN length(t) > 160 THEN rtrim(substring(t, 1, 159)) || '…' ELSE t END AS snippet FROM b""" % A.FILE_SQL,
    "strip_code": "SELECT p_partkey AS k, 'Part ' || p_partkey || ' is read here  and .' || chr(10) || chr(10) || 'Done .' AS prose FROM part",
    "citation_ranges": "SELECT p_partkey AS k, v.* FROM part, (VALUES (0::BIGINT, 10::BIGINT, 20::BIGINT), (0, 25, 25), (1, NULL, NULL)) AS v(place, lo, hi) UNION ALL SELECT p_partkey, 2, p_partkey, p_partkey FROM part",
    "reexports": "SELECT p_partkey AS k, p_size >= 0.7 * (p_size + 5) AS reexport FROM part",
    "hints": "SELECT p_partkey AS k, 'def item_named_' || lower(replace(p_type, ' ', '_')) AS line FROM part",
    "docs_side": "SELECT 'docs' AS side, count(*) FILTER (p_partkey % 3 = 0) AS n FROM part UNION ALL SELECT 'code', count(*) FILTER (p_partkey % 3 <> 0) FROM part UNION ALL SELECT 'open', count(*) FILTER (p_partkey % 3 <> 0) FROM part",
    "map_files": f"""WITH {PARTS}, m AS (SELECT *, CASE m WHEN 0 THEN 'demo' ELSE 'main' END AS grp FROM pruned), r AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, file) AS r FROM m)
      SELECT qid, file, score, 'head' AS part, r AS place FROM r WHERE grp = 'main' AND r <= 8
      UNION ALL SELECT qid, file, score, 'tail', t FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file) AS t FROM r WHERE grp = 'main' AND r > 8 AND m <> 1) WHERE t <= 8
      UNION ALL SELECT qid, file, score, 'demo', r FROM r WHERE grp = 'demo' AND r <= 2""",
    "related_docs": f"WITH {PARTS} SELECT qid, file, start_line, end_line, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file) AS r FROM pruned) WHERE r <= 5",
    "pinning_tests": """WITH w AS (SELECT 'tests/test_n' || p_partkey || '.py' AS file, p_partkey AS k, unnest([p_partkey, p_partkey + 1]) AS named FROM part), h AS (SELECT p.p_size::BIGINT AS qid, file, count(DISTINCT named) AS n, max(CASE WHEN contains('test_n' || k, 'n' || named) THEN 1 ELSE 0 END) AS own FROM w JOIN part p ON p.p_partkey = named GROUP BY ALL)
      SELECT qid, file, score FROM (SELECT qid, file, n + 10 * own AS score, row_number() OVER (PARTITION BY qid ORDER BY n + 10 * own DESC, file) AS r FROM h) WHERE r <= 8""",
    "docsearch_hits": f"""WITH d AS (SELECT doc_id % 5 AS qid, replace(path, '.md', '') AS slug, (doc_id * 7919 % 1009 + 1)::DOUBLE AS score, doc_id FROM ({A.FILE_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, slug) AS r, CAST(round(100 * score / max(score) OVER (PARTITION BY qid)) AS BIGINT) AS pct FROM d)
      SELECT qid, slug, pct, 'Doc ' || doc_id AS title, CASE WHEN starts_with(slug, 'src0') THEN 'First' WHEN starts_with(slug, 'src') THEN 'Other' ELSE '' END AS grp FROM r WHERE r <= 15""",
    "classify_broad": f"""WITH {SCORED}, {RANKED}, {BUNDLE}, t AS (SELECT qid, max(score) AS top, count(*) FILTER (tier = 1) AS core, count(DISTINCT split_part(file, '/', 1)) FILTER (tier = 1) AS dirs FROM bundle GROUP BY qid),
      s AS (SELECT qid, count(*) FILTER (tier = 2 AND via <> 'graph' AND score >= 0.92 * top) AS strong FROM bundle JOIN t USING (qid) GROUP BY qid) SELECT qid, core >= 3 OR (core >= 2 AND dirs >= 3) OR strong >= 4 AS broad FROM t JOIN s USING (qid)""",
    "ask_candidates": f"WITH {SCORED}, {RANKED}, {BUNDLE}, {CORE} SELECT qid, id, k, k * 100 <= 1050 AS whole FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY role <> 'core', score DESC, id) AS k FROM chosen)",
    "agent_plan": f"""WITH {SCORED}, {RANKED}, {BUNDLE}, d AS (SELECT qid, split_part(file, '/', 1) AS dir, count(*) AS n, list(file) AS files FROM bundle GROUP BY ALL), r AS (SELECT *, least(row_number() OVER (PARTITION BY qid ORDER BY n DESC, dir), 4) AS agent FROM d)
      SELECT qid, agent, array_to_string(list_sort(flatten(list(files))), ',') AS files FROM r GROUP BY qid, agent""",
    "rerank_setaside": f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM r WHERE rank <= 40 AND id % 3 <> 0 AND (score >= 0.85 * top OR rank <= 10) AND file NOT LIKE 'tests/%')
      SELECT qid, id, file, score FROM k WHERE n <= 8""",
    "flow_stale": f"WITH {FLOWS} SELECT id FROM c WHERE NOT current",
    "flow_prune": f"WITH {FLOWS} SELECT id FROM c WHERE current",
    "flow_listing": f"WITH {FLOWS} SELECT id, id::DOUBLE AS created, NOT current AS stale FROM c",
    "flow_serve": f"""WITH {FLOWS}, m AS (SELECT a.id AS qid, b.id, {SIM} AS sim, a.question AS asked, b.question AS known, b.current FROM c a, c b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM m WHERE sim >= 0.62),
      t AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(asked), '[a-z0-9_]+')), lambda x: length(x) > 1 AND NOT list_contains({T.STOP_WORDS}, x)) AS q, list_filter(list_distinct(regexp_extract_all(lower(known), '[a-z0-9_]+')), lambda x: length(x) > 1 AND NOT list_contains({T.STOP_WORDS}, x)) AS h FROM r WHERE rank <= 2 AND sim >= 0.88 AND current)
      SELECT qid, arg_min(id, rank) AS id FROM t WHERE len(q) = 0 OR len(list_intersect(q, h)) / len(q) >= 0.8 GROUP BY qid""",
    "flow_lane": f"""WITH {FLOWS}, {SCORED}, {RANKED}, {BUNDLE}, m AS (SELECT q.qid, c.id, c.path, round((list_inner_product(c.vec, q.qvec) + 1) / 2, 6) AS sim FROM c, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM m WHERE sim >= 0.62),
      x AS (SELECT qid, path AS file, min(rank) AS rank FROM r WHERE rank <= 2 GROUP BY ALL) SELECT qid, file FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, file) AS k FROM x WHERE NOT EXISTS (SELECT 1 FROM bundle b WHERE b.qid = x.qid AND b.file = x.file)) WHERE k <= 3""",
    "span_iou": f"WITH {MEASURE} SELECT qid, path, round(iou, 6) AS iou, hit1::BIGINT AS hit1, hit5::BIGINT AS hit5 FROM own WHERE h = 12",
    "ab_verdict": f"""WITH {MEASURE}, f AS (SELECT path, sum(iou) FILTER (h = 30) AS a, sum(iou) FILTER (h = 12) AS b, sum(hit1) FILTER (h = 30) AS ha, sum(hit1) FILTER (h = 12) AS hb, count(*) FILTER (h = 30) AS n FROM own GROUP BY path),
      r AS (SELECT sum(a) / sum(n) AS iou_a, sum(b) / sum(n) AS iou_b, sum(ha)::BIGINT AS hit_a, sum(hb)::BIGINT AS hit_b, min(b / n - a / n) AS worst FROM f) SELECT round(iou_a, 6) AS iou_a, round(iou_b, 6) AS iou_b, hit_a, hit_b, round(worst, 6) AS worst, iou_b - iou_a >= 0.01 AND hit_b >= hit_a AND worst >= -0.01 AS win FROM r""",
    "changed_files": "SELECT 'f' || p_partkey AS path FROM part WHERE p_partkey % 7 = 0",
    "too_fine": "SELECT 'f' || p_partkey AS path FROM part WHERE p_partkey % 5 = 0",
    "replace_edges": f"""WITH e AS ({A.SUPPLY_SQL}) SELECT src, dst, kind FROM e WHERE src NOT IN ('supplier/1', 'supplier/2', 'supplier/3', 'supplier/4', 'supplier/5', 'supplier/6', 'supplier/7') AND dst <> 'part/2'
      UNION ALL SELECT 'supplier/' || i, 'part/1', 'new' FROM (SELECT unnest(range(1, 6)) AS i)""",
    "replace_rows": "SELECT 'f' || p_partkey AS file, unnest(string_split(p_name, ' ')) AS name FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'f' || p_partkey, 'new' FROM part WHERE p_partkey % 4 = 0",
}
from tarnwick.plans.lexical import LINES  # noqa: E402

ORACLES["ignore_lines"] = ORACLES["ignore_lines"] % LINES
