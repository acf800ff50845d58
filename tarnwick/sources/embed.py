"""Embedders: vectors for texts, with a cache by content."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions.vectors import large

RETRY = {429, 500, 502, 503, 504}


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic bag of words: each [A-Za-z_]+ in lower case counts in the bucket of its MD5's first four bytes."""

    def __init__(self, dims: int = 256):
        self.dims, self.name = dims, f"hash-{dims}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for k, t in enumerate(texts):
            for w, n in Counter(re.findall(r"[A-Za-z_]+", t.lower())).items():
                out[k, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dims] += n
        return normalised(out)


def normalised(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def decoded(item: str | list[float]) -> np.ndarray:
    """A vector as it comes over the wire: base64 of int8, or a list of numbers."""
    return np.frombuffer(base64.b64decode(item), dtype=np.int8).astype(float) if isinstance(item, str) else np.asarray(item, dtype=float)


def batches(texts: list[str], most: int = 128, tokens: float = 100_000) -> Iterator[list[str]]:
    """Batches bounded by number and by estimated tokens (1.9 characters each)."""
    held: list[str] = []
    size = 0.0
    for t in texts:
        n = len(t) / 1.9
        if held and (len(held) >= most or size + n > tokens):
            yield held
            held, size = [], 0.0
        held.append(t)
        size += n
    if held:
        yield held


class HttpEmbedder:
    """An OpenAI-compatible endpoint: retries what may pass, halves a batch that is refused as too large, fails as a whole otherwise."""

    def __init__(self, url: str, model: str, key: str = "", dims: int | None = None, tries: int = 4):
        self.url, self.name, self.key, self.dims, self.tries = url.rstrip("/") + "/embeddings", model, key, dims, tries

    def _post(self, body: dict) -> dict:
        req = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(req, timeout=120) as r:
                    out = json.load(r)
                if "error" in out:
                    raise RuntimeError(str(out["error"]))
                return out
            except urllib.error.HTTPError as e:
                if e.code not in RETRY or k == self.tries - 1:
                    raise
                time.sleep(2**k)
        raise RuntimeError("no answer")

    def _request(self, texts: list[str]) -> np.ndarray:
        try:
            data = sorted(self._post({"model": self.name, "input": texts})["data"], key=lambda x: x["index"])
        except urllib.error.HTTPError as e:
            if e.code not in (400, 413) or len(texts) == 1:
                raise
            half = len(texts) // 2
            return np.concatenate([self._request(texts[:half]), self._request(texts[half:])])
        out = normalised(np.stack([decoded(x["embedding"]) for x in data]))
        if self.dims and out.shape[1] != self.dims:
            raise ValueError(f"{out.shape[1]} dimensions, not {self.dims}")
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._request(b) for b in batches(texts)]) if texts else np.zeros((0, self.dims or 1))


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "vec", cache: DataFrame | None = None) -> DataFrame:
    """rows with a vector; texts whose (model, text) key is in the cache (key, vec) are not sent."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(list(embedder.embed(s.fillna("").tolist()).astype(np.float32)))

    vector = F.pandas_udf(run, "array<float>")
    keyed = rows.withColumn("_key", T.cache_key(embedder.name, F.coalesce(F.col(text), F.lit(""))))
    if cache is None:
        return keyed.withColumn(out, vector(F.col(text))).drop("_key")
    known = cache.select(F.col("key").alias("_key"), F.col("vec").alias(out)).dropDuplicates(["_key"])
    known = large(known)
    hit = keyed.join(known, "_key")
    miss = keyed.join(known, "_key", "left_anti").withColumn(out, vector(F.col(text)))
    return hit.unionByName(miss).drop("_key")


def cache_rows(rows: DataFrame, embedder: Embedder, text: str = "text", vec: str = "vec") -> DataFrame:
    return rows.select(T.cache_key(embedder.name, F.col(text)).alias("key"), F.col(vec).alias("vec")).dropDuplicates(["key"])
