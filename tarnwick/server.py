"""An HTTP service over one index, with a rate limit: routes to read, tools to call, and answers as a stream of events."""

from __future__ import annotations

import itertools
import json
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tarnwick import service
from tarnwick.operators import graph, render
from tarnwick.plans.indexer import Engine
from tarnwick.streaming.limiter import allow


class RateLimiter:
    """At most so many hits an address in a window; a hit that was served from the cache is given back."""

    def __init__(self, limit: int, seconds: float = 3600):
        self.limit, self.seconds, self.lock = limit, seconds, threading.Lock()
        self.held: dict[str, deque] = defaultdict(deque)

    def hit(self, who: str, now: float | None = None) -> bool:
        with self.lock:
            return allow([time.time() if now is None else now], self.limit, self.seconds, self.held[who])[0]

    def refund(self, who: str) -> None:
        with self.lock:
            if self.held[who]:
                self.held[who].pop()


def routes(e: Engine) -> dict[str, Callable[[dict[str, str]], object]]:
    rows = lambda df, n=200: [r.asDict(True) for r in df.limit(n).collect()]

    def scope(q: dict[str, str]) -> dict:
        return {"scope": q.get("path"), "docs": {"1": True, "0": False}.get(q.get("docs", ""))}

    return {
        "/health": lambda q: {"ok": True},
        "/stats": lambda q: rows(e.stats()),
        "/search": lambda q: rows(e.search([q["q"]], **scope(q)).orderBy("tier", "place")),
        "/render": lambda q: render.render_bundle(q["q"], rows(e.search([q["q"]], **scope(q)))),
        "/prune": lambda q: rows(e.prune([q["q"]], **scope(q))),
        "/grep": lambda q: service.grep_rows(e, {"pattern": q["pattern"], "regex": q.get("regex") == "1", "ignore_case": q.get("i") == "1", "path": q.get("path")}),
        "/chunks": lambda q: rows(e.tables["chunks"].where(e.tables["chunks"]["file"] == q["file"]).drop("vec").orderBy("start_line")),
        "/symbols": lambda q: rows(e.tables["symbols"].where(e.tables["symbols"]["file"] == q["file"]).orderBy("line")),
        "/graph": lambda q: rows(graph.central_files(e.tables["files"], e.tables["edges"], e.tables["symbols"])),
        "/path": lambda q: service.graph(e, {"from": q["from"], "to": q["to"]}),
        "/node": lambda q: service.graph(e, {"node": q["node"]}),
        "/map": lambda q: service.map_repo(e, {"query": q["q"]}),
        "/flows": lambda q: rows(e.tables["flows"].select("id", "question", "created")),
    }


def serve(engine: Engine, port: int = 0, limit: int = 600, narrator=None) -> ThreadingHTTPServer:
    """A server on the local address, not yet running: call serve_forever()."""
    table, limiter = routes(engine), RateLimiter(limit)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path not in table:
                return self._send(404, {"error": "unknown route"})
            if not limiter.hit(self.client_address[0]):
                return self._send(429, {"error": "too many requests"})
            try:
                self._send(200, table[url.path]({k: v[0] for k, v in parse_qs(url.query).items()}))
            except KeyError as x:
                self._send(400, {"error": f"{x.args[0]} is missing"})
            except Exception as x:
                self._send(500, {"error": str(x)[:300]})

        def do_POST(self) -> None:
            """/tools/<name> calls a tool with the JSON object of the body; /ask streams the events of an answer."""
            name = urlsplit(self.path).path
            if not limiter.hit(self.client_address[0]):
                return self._send(429, {"error": "too many requests"})
            try:
                said = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                if name == "/ask":
                    events = service.ask_events(engine, said["query"], narrator)
                    first = next(events)
                    self.send_response(200)
                    self.send_header("Content-Type", "text/event-stream")
                    self.end_headers()
                    for kind, data in itertools.chain([first], events):
                        self.wfile.write(f"event: {kind}\ndata: {json.dumps(data, default=str)}\n\n".encode())
                elif name.removeprefix("/tools/") in service.TOOLS:
                    self._send(200, service.TOOLS[name.removeprefix("/tools/")](engine, said))
                else:
                    self._send(404, {"error": "unknown route"})
            except (KeyError, ValueError) as x:
                self._send(400, {"error": str(x)[:300]})
            except Exception as x:
                self._send(500, {"error": str(x)[:300]})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
