"""The engine's tools behind every surface: the command line, HTTP and the model context protocol call the same functions.

A tool takes the engine and a dictionary of arguments and returns what JSON can say.  Everything it collects
is bounded by a query's answer: bundles, capped sections with their true counts, files that were asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.operators import ask as A
from tarnwick.operators import bundle as B
from tarnwick.operators import corpus as C
from tarnwick.operators import files as FI
from tarnwick.operators import flows as FL
from tarnwick.operators import graph as G
from tarnwick.operators import grep as GR
from tarnwick.operators import mapcard as M
from tarnwick.operators import related as RE
from tarnwick.operators import render
from tarnwick.plans.indexer import Engine

SECTION, RENDERED, NEAR, PAGE = 200, 40, 25, 400


def _rows(df: DataFrame, most: int = PAGE) -> list[dict]:
    return [r.asDict(True) for r in df.limit(most).collect()]


# --- search ---------------------------------------------------------------------------------------------------------
def entries(e: Engine, query: str, scope: str | None = None, docs: bool | None = None) -> tuple[list[dict], DataFrame]:
    """The bundle's files with what an answer shows of each, and the scored chunks, kept until the caller lets them go.

    Of core files the kept chunks by line; of all files the names of the three best chunks, the first doc line
    and up to twelve symbols; and files that earlier answers to such a question cite.
    """
    scored = e.scored([query], scope, docs).persist()
    bundle = B.assemble(scored, e.tables["edges"], e.p)
    matched = FL.match_flows(e.tables["flows"], e._queries([query]), e.p)
    more = FL.flow_lane(bundle, matched, e.tables["flows"]).select("file")
    own = [r.asDict(True) for r in bundle.orderBy("tier", "place").collect()]  # a bundle
    last = max((x["place"] for x in own), default=0)
    own += [{"qid": 0, "file": r["file"], "score": 0.0, "best": None, "tier": 2, "via": "flow", "place": last + i + 1} for i, r in enumerate(more.collect())]
    named = e.spark.createDataFrame([(x["file"],) for x in own], "file string") if own else None
    if named is None:
        return [], scored
    top = Window.partitionBy("file").orderBy(F.col("score").desc(), "id")
    best = scored.join(e.tables["chunks"].select("id", "name"), "id").join(F.broadcast(named), "file", "left_semi").withColumn("r", F.row_number().over(top)).where("r <= 3 and name <> ''")
    matched_names = {r["file"]: r["names"] for r in best.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("names")).collect()}
    sym = e.tables["symbols"].join(F.broadcast(named), "file", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where("r <= 12")
    outline: dict[str, list[dict]] = {}
    for r in sym.orderBy("file", "line").collect():
        outline.setdefault(r["file"], []).append({"name": r["name"], "kind": r["kind"], "line": r["line"], "doc": r["doc"]})
    kept = B.core_chunks(scored, bundle, e.p).select("id").join(e.tables["chunks"].drop("vec"), "id").orderBy("file", "start_line")
    chunks: dict[str, list[dict]] = {}
    for r in kept.collect():  # at most chunk_cap of each core file
        chunks.setdefault(r["file"], []).append(r.asDict())
    for x in own:
        x |= {"matched": [n["name"] for n in matched_names.get(x["file"], [])], "outline": outline.get(x["file"], []), "chunks": chunks.get(x["file"], [])}
        x["doc"] = next((s["doc"] for s in x["outline"] if s["doc"]), "")
    return own, scored


def search(e: Engine, a: dict) -> dict:
    """query, path, docs -> the tiered bundle with its payload, and the same as text."""
    found, scored = entries(e, a["query"], a.get("path"), a.get("docs"))
    scored.unpersist()
    return {"query": a["query"], "entries": found, "text": render.render_bundle(a["query"], found)}


def prune(e: Engine, a: dict) -> dict:
    """query, path -> chunks worth reading, the other spans of those files, counts, related documents, the change log and tests that pin the names."""
    scored = e.scored([a["query"]], a.get("path"), a.get("docs")).persist()
    spans = e.tables["chunks"].select("id", "name", "start_line", "end_line", "text")
    rows = B.prune(scored, B.assemble(scored, e.tables["edges"], e.p), e.p).join(spans, "id").persist()
    kept = _rows(rows.where("role <> 'noise'").orderBy(F.col("score").desc(), "id"))
    noise = _rows(rows.where("role = 'noise'").select("file", "start_line", "end_line").orderBy("file", "start_line"))
    is_doc = T.extension("file").isin("md", "mdx", "markdown", "rst", "txt")
    docs = RE.related_docs(scored.where(is_doc).select("qid", "file", "start_line", "end_line", "score"))
    names = rows.where("role = 'core' and name <> ''").select("qid", F.explode(F.split("name", ", ")).alias("name")).select("qid", F.element_at(F.split("name", "[.]"), -1).alias("name")).distinct()
    tests = RE.pinning_tests(e.tables["chunks"], names)
    log = RE.changelog(e.tables["files"]).select("path").first()
    out = {
        "kept": kept, "noise_map": noise, "counts": {"kept": len(kept), "pruned": rows.where("role = 'noise'").count(), "scanned": scored.count()},
        "docs_indexed": not e.tables["chunks"].where(is_doc).isEmpty(), "related_docs": _rows(docs.orderBy(F.col("score").desc(), "file")),
        "tests": _rows(tests.orderBy(F.col("score").desc(), "file")), "changelog": log["path"] if log else None, "text": render.render_pruned(a["query"], kept),
    }
    for df in (rows, scored):
        df.unpersist()
    return out


def docsearch(e: Engine, a: dict) -> list[dict]:
    """query, groups ([prefix, name] pairs in order) -> best passage of each page."""
    scored = e.scored([a["query"]], docs=True).join(e.tables["chunks"].select("id", "breadcrumb", "text"), "id")
    hits = scored.select("qid", F.col("file").alias("path"), "breadcrumb", "text", "score")
    return _rows(B.docsearch(hits, [tuple(x) for x in a.get("groups", [])]).orderBy(F.col("pct").desc(), "slug"))


def grep(e: Engine, a: dict) -> dict:
    """pattern, regex, ignore_case, path -> hits by section, at most SECTION each, with the true counts, and who reaches the files of reads."""
    hits = e.grep(a["pattern"], regex=bool(a.get("regex")), ignore_case=bool(a.get("ignore_case")), scope=a.get("path")).persist()
    rows = [r.asDict() for r in GR.sections(hits, SECTION).orderBy("role", "place").collect()]  # a few sections, each capped
    reached = GR.reached_from(e.tables["edges"], hits.where("role = 'reads'").select("file"))
    ways = {r["file"]: r["reached_from"] for r in reached.limit(SECTION).collect()}
    hits.unpersist()
    sections = {role: {"total": next(r["total"] for r in rows if r["role"] == role), "hits": [{k: r[k] for k in ("file", "line", "text", "symbol", "in_degree")} for r in rows if r["role"] == role]} for role in GR.ORDER if any(r["role"] == role for r in rows)}
    return {"pattern": a["pattern"], "sections": sections, "reached_from": ways, "text": render_grep(a["pattern"], sections, ways)}


def grep_rows(e: Engine, a: dict) -> list[dict]:
    """The hits of grep() in one list, each with its role and the true count of that role."""
    return [{**h, "role": role, "total": s["total"]} for role, s in grep(e, a)["sections"].items() for h in s["hits"]]


def render_grep(pattern: str, sections: dict, ways: dict[str, list[str]]) -> str:
    """Sections as text, at most RENDERED lines each; who reaches a file is said at its first line."""
    out, said = [f"# {pattern}"], set()
    for role, s in sections.items():
        out.append(f"## {role} ({s['total']})")
        for h in s["hits"][:RENDERED]:
            out.append(f"{h['file']}:{h['line']}: {h['text'].strip()}" + (f"  [{h['symbol']}]" if h["symbol"] else ""))
            if h["file"] in ways and h["file"] not in said:
                said.add(h["file"])
                out.append("    reached from " + ", ".join(ways[h["file"]]))
        if s["total"] > RENDERED:
            out.append(f"... {s['total'] - min(RENDERED, len(s['hits']))} more")
    return "\n".join(out)


# --- map ------------------------------------------------------------------------------------------------------------------
def map_repo(e: Engine, a: dict) -> dict:
    """query -> a card: the first files with spans, outline and links, then others, where names are defined, and how they are used."""
    q = e.spark.createDataFrame([(0, a["query"])], "qid long, query string")
    scored = e.scored([a["query"]]).persist()
    pruned = B.prune(scored, B.assemble(scored, e.tables["edges"], e.p), e.p).where("role <> 'noise'").join(e.tables["chunks"].select("id", "start_line", "end_line"), "id").persist()
    files = [r.asDict() for r in M.head_and_tail(pruned).orderBy("part", "place").collect()]  # HEAD, TAIL and DEMOS at most
    order = {"head": 0, "tail": 1, "demo": 2}
    files.sort(key=lambda x: (order[x["part"]], x["place"]))
    head = [x["file"] for x in files if x["part"] == "head"]
    spans = pruned.where(F.col("file").isin(head) if head else F.lit(False)).select("qid", "file", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), "score")
    four = spans.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(F.col("score").desc(), "lo"))).where("r <= 4")
    outline = M.outline(spans.where(F.col("file").isin(head[:3]) if head else F.lit(False)), e.tables["symbols"])
    links = M.links(e.tables["edges"], e.spark.createDataFrame([(x,) for x in head], "file string"))
    defines = M.defines(q, e.tables["symbols"])
    names = defines.select("qid", F.element_at(F.split("said", "[.]"), -1).alias("said")).distinct()
    lines = C.line_table(e.tables["chunks"].select(F.concat_ws("\0", "file", F.col("start_line").cast("string")).alias("path"), "text"))
    at = lines.select(F.split("path", "\0")[0].alias("file"), (F.split("path", "\0")[1].cast("int") + F.col("line") - 1).alias("line"), "text")
    sites = M.trail(names, at, e.tables["symbols"]).withColumn("r", F.row_number().over(Window.partitionBy("said", "kind").orderBy("file", "line"))).where(F.col("r") <= F.when(F.col("kind") == "tests", 2).when(F.col("kind") == "defines", 1).otherwise(3))
    out = {"query": a["query"], "files": files, "spans": _rows(four.select("file", "lo", "hi").orderBy("file", "lo")), "outline": _rows(outline.orderBy("file", "line")), "links": _rows(links.orderBy("file", "way", "other")),
           "defines": _rows(defines.select("said", "file", "line").orderBy("said", "file", "line")), "trail": _rows(sites.select("said", "kind", "file", "line").orderBy("said", "kind", "file", "line"))}
    for df in (pruned, scored):
        df.unpersist()
    return out | {"text": render_map(out)}


def render_map(card: dict) -> str:
    out = [f"# {card['query']}"]
    for x in card["files"]:
        out.append(f"{'##' if x['part'] == 'head' else '-'} {x['file']}" + ("" if x["part"] != "head" else "  " + ", ".join(f"L{s['lo']}-{s['hi']}" for s in card["spans"] if s["file"] == x["file"])))
        out += [f"    {s['line']}: {s['name']}" for s in card["outline"] if s["file"] == x["file"]]
        out += [f"    {'<-' if s['way'] == 'reached_from' else '->'} {s['other']}" for s in card["links"] if s["file"] == x["file"]]
    out += [f"DEFINES {d['said']}  {d['file']}:{d['line']}" for d in card["defines"]]
    out += [f"{t['kind'].upper()} {t['said']}  {t['file']}:{t['line']}" for t in card["trail"]]
    return "\n".join(out)


# --- graph ------------------------------------------------------------------------------------------------------------------
def graph(e: Engine, a: dict) -> dict:
    """Without arguments the whole graph's hubs, communities and surprises; node: one file's neighbours; from and to: a path."""
    files, edges = e.tables["files"], e.tables["edges"]
    if a.get("from"):
        ends = [G.resolve_node(files, a[k]).first() for k in ("from", "to")]
        if not all(ends):
            return {"path": [], "text": "no such file"}
        path = G.shortest_path(edges, G.semantic_edges(files, e.p), ends[0]["path"], ends[1]["path"])
        hops = {(r["src"], r["dst"]): sorted(r["kinds"]) for r in edges.where(F.col("src").isin(path) & F.col("dst").isin(path)).groupBy("src", "dst").agg(F.collect_set("kind").alias("kinds")).collect()}
        steps = [{"from": x, "to": y, "kinds": hops.get((x, y)) or hops.get((y, x)) or ["similar"], "forward": (x, y) in hops} for x, y in zip(path, path[1:])]
        return {"path": path, "hops": steps, "text": "\n".join([path[0] if path else "no path", *(f"{'->' if s['forward'] else '<-'} ({', '.join(s['kinds'])}) {s['to']}" for s in steps)])}
    if a.get("node"):
        row = G.resolve_node(files, a["node"]).first()
        if not row:
            return {"node": None, "text": "no such file"}
        at = F.lit(row["path"])
        out = {"node": row["path"], "reaches": [r["dst"] for r in edges.where(F.col("src") == at).select("dst").distinct().orderBy("dst").limit(NEAR).collect()], "reached_from": [r["src"] for r in edges.where(F.col("dst") == at).select("src").distinct().orderBy("src").limit(NEAR).collect()]}
        near = G.similarities_to(files, row["path"], e.p.semantic_min).orderBy(F.col("cosine").desc(), "b").limit(NEAR)
        out["similar"] = _rows(near)
        return out | {"text": "\n".join([out["node"], *(f"-> {x}" for x in out["reaches"]), *(f"<- {x}" for x in out["reached_from"]), *(f"~ {x['b']} ({x['cosine']:.2f})" for x in out["similar"])])}
    near = G.semantic_edges(files, e.p)
    parts = G.communities(files, edges, near).persist()
    groups = _rows(parts.groupBy("community").agg(F.count("*").alias("files"), F.array_sort(F.collect_list("file")).alias("names")).select("community", "files", F.slice("names", 1, 8).alias("names")).orderBy("community"), NEAR)
    out = {"central": _rows(G.central_files(files, edges, e.tables["symbols"])), "hubs": _rows(G.god_nodes(edges)), "communities": groups, "surprises": _rows(G.surprises(files, edges, parts, e.p))}
    parts.unpersist()
    return out | {"text": "\n".join([*(f"{x['file']} ({x['degree']})" for x in out["hubs"]), *(f"community {x['community']}: {x['files']} files, {', '.join(x['names'])}" for x in groups), *(f"{x['a']} ~ {x['b']} ({x['cosine']:.2f})" for x in out["surprises"])])}


# --- read, flows, ask ---------------------------------------------------------------------------------------------------------
def get(e: Engine, a: dict) -> list[dict]:
    """specs -> their text, read from the indexed chunks, with the status of each."""
    texts = e.tables["chunks"].groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda c: c["text"]), "\n").alias("text"))
    named = [FI.parse_spec(s)["path"] for s in a["specs"]]
    rows = FI.read_specs(e.spark, texts.where(F.col("path").isin(named)), e.tables["symbols"], a["specs"])
    return _rows(rows.orderBy("seq", "sub"))


def chunks(e: Engine, a: dict) -> list[dict]:
    """file -> its chunks."""
    return _rows(e.tables["chunks"].where(F.col("file") == a["file"]).drop("vec").orderBy("start_line"))


def symbols(e: Engine, a: dict) -> list[dict]:
    """name -> where it is defined."""
    return _rows(GR.find_symbols(e.tables["symbols"], a["name"]).orderBy("file", "line"))


def flows(e: Engine, a: dict) -> list[dict]:
    """Answers that are stored, newest first; with an id that one alone, with its text."""
    own = e.tables["flows"]
    if a.get("id") is not None:
        return _rows(own.where(F.col("id") == a["id"]).drop("vec", "qvec"))
    return _rows(FL.listing(own, e.tables["files"]))


def stats(e: Engine, a: dict) -> list[dict]:
    """Rows of each relation."""
    return _rows(e.stats())


def ask_events(e: Engine, query: str, narrator: A.Narrator | None = None) -> Iterator[tuple[str, object]]:
    """The events of an answer: files found, whether the question is broad, pieces of text with code spliced in, and the end.

    A stored answer that covers the question is served as it is; without a narrator, or where it fails or cites
    nothing, the rendered bundle is the answer.
    """
    q = e._queries([query])
    served = FL.serve(e.tables["flows"], q, e.tables["files"], e.p).first()
    if served:
        row = e.tables["flows"].where(F.col("id") == served["id"]).select("text", F.map_keys("files").alias("files")).first()
        yield "bundle", {"files": row["files"]}
        yield "text", row["text"]
        yield "done", {"served": served["id"], "files": row["files"], "narrated": True}
        return
    found, scored = entries(e, query)
    yield "bundle", {"files": [x["file"] for x in found]}
    bundle = e.spark.createDataFrame([(0, x["file"], float(x["score"]), x["tier"], x["via"]) for x in found], "qid long, file string, score double, tier long, via string")
    broad = B.classify(bundle, q.select("qid", "query")).first()
    yield "plan", {"broad": bool(broad and broad["broad"]), "agents": [r["files"] for r in A.plan_by_directory(bundle).orderBy("agent").collect()] if broad and broad["broad"] else []}
    chosen = B.selection(scored, B.assemble(scored, e.tables["edges"], e.p), e.p).join(e.tables["chunks"].select("id", "start_line", "end_line", "text"), "id")
    cands = [r.asDict() for r in A.candidates(chosen).orderBy("k").collect() if r["text"] is not None]
    scored.unpersist()
    of = {x["file"] for x in cands}
    own: dict[str, list[dict]] = {}
    for r in e.tables["symbols"].where(F.col("file").isin(sorted(of))).select("file", "name", "line", "end_line").orderBy("file", "line").collect() if of else []:
        own.setdefault(r["file"], []).append(r.asDict())
    out = A.answer(query, cands, narrator, render.render_bundle(query, found), own)
    for page in A.paginate(out["text"]):
        yield "text", page
    yield "done", {"served": None, "files": out["files"], "narrated": out["narrated"]}


def ask(e: Engine, a: dict) -> dict:
    """query -> the answer as one text."""
    events = list(ask_events(e, a["query"], a.get("narrator")))
    return {"text": "\n".join(str(x) for kind, x in events if kind == "text"), **next(x for kind, x in events if kind == "done")}


def plan(e: Engine, a: dict) -> dict:
    """query -> whether it is broad, and the files of each agent's work."""
    for kind, data in ask_events(e, a["query"]):
        if kind == "plan":
            return data
    return {"broad": False, "agents": []}


TOOLS = {"search": search, "prune": prune, "docsearch": docsearch, "grep": grep, "map": map_repo, "graph": graph, "get": get, "chunks": chunks, "symbols": symbols, "flows": flows, "stats": stats, "ask": ask, "plan": plan}


# --- the model context protocol -----------------------------------------------------------------------------------------------
NEEDS = {"search": ["query"], "prune": ["query"], "docsearch": ["query"], "grep": ["pattern"], "map": ["query"], "graph": [], "get": ["specs"], "chunks": ["file"], "symbols": ["name"], "flows": [], "stats": [], "ask": ["query"], "plan": ["query"]}


def described() -> list[dict]:
    """The tools as the protocol lists them."""
    kinds = {"specs": {"type": "array", "items": {"type": "string"}}}
    return [{"name": n, "description": (f.__doc__ or "").strip(), "inputSchema": {"type": "object", "properties": {k: kinds.get(k, {"type": "string"}) for k in NEEDS[n]}, "required": NEEDS[n]}} for n, f in TOOLS.items()]


def answered(e: Engine, said: dict) -> dict | None:
    """One JSON-RPC message's reply; None for a notification."""
    if "id" not in said:
        return None
    reply = lambda **x: {"jsonrpc": "2.0", "id": said["id"], **x}
    method, params = said.get("method"), said.get("params") or {}
    if method == "initialize":
        return reply(result={"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tarnwick", "version": "0.2.0"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": described()})
    if method != "tools/call":
        return reply(error={"code": -32601, "message": f"no method {method}"})
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return reply(error={"code": -32602, "message": f"no tool {name}"})
    lacks = [k for k in NEEDS[name] if k not in args]
    if lacks:
        return reply(error={"code": -32602, "message": f"{', '.join(lacks)} is missing"})
    try:
        out = TOOLS[name](e, args)
    except Exception as x:  # the tool's failure is part of the answer, not of the protocol
        return reply(result={"isError": True, "content": [{"type": "text", "text": str(x)[:300]}]})
    text = out["text"] if isinstance(out, dict) and "text" in out else json.dumps(out, default=str)
    return reply(result={"content": [{"type": "text", "text": text}]})


def stdio(e: Engine, read: TextIO, write: TextIO) -> str:
    """Serve the protocol line by line until the input ends."""
    for line in read:
        if not line.strip():
            continue
        try:
            out = answered(e, json.loads(line))
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if out is not None:
            write.write(json.dumps(out, default=str) + "\n")
            write.flush()
    return ""
