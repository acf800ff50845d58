"""Relations of the engine."""

from __future__ import annotations

FILES = "path string, sha string, skeleton string, skel_vec array<float>"
CHUNKS = "id long, file string, kind string, name string, part string, start_line int, end_line int, text string, breadcrumb string, vec array<float>"
SYMBOLS = "file string, name string, kind string, line int, end_line int, signature string, decorators array<string>, doc string"
EDGES = "src string, dst string, kind string"
FLOWS = "id long, question string, text string, files map<string,string>, vec array<float>, qvec array<float>, created double"
META = "k string, v string"
