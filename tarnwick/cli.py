"""Command line: scan, index, search, map, ask, grep, get, graph, chunks, flows, stats, trust, serve and mcp over an index."""

from __future__ import annotations

import argparse
import json
import sys

from tarnwick import server, service
from tarnwick.operators import forge
from tarnwick.plans import indexer
from tarnwick.session import local_session
from tarnwick.sources import scan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnwick")
    p.add_argument("--index", default=".tarnwick", help="folder of the index")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("root")
    a.add_argument("--force", action="store_true")
    a.add_argument("--exclude", action="append", default=[], help="a name, path or glob that is left out")
    a.add_argument("--no-gitignore", action="store_true")
    a = sub.add_parser("scan")
    a.add_argument("root")
    a.add_argument("--exclude", action="append", default=[])
    a = sub.add_parser("get")
    a.add_argument("specs", nargs="+", help="path, path#name or path:lo-hi")
    a = sub.add_parser("map")
    a.add_argument("query")
    a = sub.add_parser("ask")
    a.add_argument("query")
    a = sub.add_parser("serve")
    a.add_argument("--port", type=int, default=8080)
    sub.add_parser("mcp")
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("--path")
    a.add_argument("--docs", action="store_true")
    a.add_argument("--prune", action="store_true")
    a = sub.add_parser("grep")
    a.add_argument("pattern")
    a.add_argument("--regex", action="store_true")
    a.add_argument("-i", "--ignore-case", action="store_true")
    a.add_argument("--path")
    a = sub.add_parser("graph")
    a.add_argument("--node")
    a.add_argument("--path", nargs=2, metavar=("FROM", "TO"))
    a = sub.add_parser("chunks")
    a.add_argument("file")
    a = sub.add_parser("trust")
    a.add_argument("strategy")
    a.add_argument("--store", required=True)
    sub.add_parser("flows")
    sub.add_parser("stats")
    return p


def run(args: argparse.Namespace, spark=None) -> list[dict] | dict | str:
    if args.command == "trust":
        forge.Trust(args.store).add(args.strategy)
        return {"trusted": args.strategy}
    spark = spark or local_session(name="tarnwick-cli")
    if args.command == "index":
        files = scan.discovered(spark, args.root, patterns=args.exclude, gitignore=not args.no_gitignore)
        return indexer.index(spark, files, args.index, force=args.force)
    if args.command == "scan":
        return scan.report(spark, args.root, args.exclude)
    e = indexer.Engine(spark, args.index)
    rows = lambda df, n=200: [r.asDict(True) for r in df.limit(n).collect()]
    if args.command in ("map", "ask"):
        return service.TOOLS[args.command](e, {"query": args.query})["text"]
    if args.command == "get":
        return service.get(e, {"specs": args.specs})
    if args.command == "mcp":
        return service.stdio(e, sys.stdin, sys.stdout)
    if args.command == "serve":
        server.serve(e, args.port).serve_forever()
    if args.command == "search" and args.prune:
        return rows(e.prune([args.query], args.path, args.docs or None).orderBy("role", "score"))
    if args.command == "search":
        return service.search(e, {"query": args.query, "path": args.path, "docs": args.docs or None})["text"]
    if args.command == "grep":
        return service.grep_rows(e, {"pattern": args.pattern, "regex": args.regex, "ignore_case": args.ignore_case, "path": args.path})
    if args.command == "graph" and args.path:
        return {"path": service.graph(e, {"from": args.path[0], "to": args.path[1]})["path"]}
    if args.command == "graph" and args.node:
        out = service.graph(e, {"node": args.node})
        return [{"file": out["node"], "hops": 0}, *({"file": f, "hops": 1} for f in sorted({*out["reaches"], *out["reached_from"]}))] if out["node"] else []
    if args.command == "graph":
        return service.graph(e, {})["central"]
    if args.command == "chunks":
        return rows(e.tables["chunks"].where(e.tables["chunks"]["file"] == args.file).select("file", "kind", "name", "start_line", "end_line").orderBy("start_line"))
    if args.command == "flows":
        return rows(e.tables["flows"].select("id", "question", "created"))
    return rows(e.stats())


def main(argv: list[str] | None = None) -> int:
    try:
        out = run(parser().parse_args(argv))
    except indexer.IndexNotFound as e:
        print(f"no index in {e}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
