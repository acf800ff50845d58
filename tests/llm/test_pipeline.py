"""Each stage of the pipeline against a plain version, and the whole run."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute

ROWS = brute.documents(2)
ITEMS = [(1, " ".join(ROWS[36][1].split(" ")[30:90])), (2, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, brute.COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(r[0], 1, int(k % 6 == 0)) for k, r in enumerate(ROWS[:40])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxic_documents_go(spark, docs, sf_dir):
    from tarnwick.llm import toxicity

    out = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    scores = {(r["doc_id"], r["text"]): r["predicted"] for r in toxicity.scored(docs.select("doc_id", "text"), toxicity.model_of(spark, sf_dir)).collect()}
    assert out.columns == docs.columns
    assert rows(out) == Counter({r: n for r, n in rows(docs).items() if not scores[r[0], r[1]]})


def test_one_of_each_group_stays(spark, docs, sf_dir):
    out = rows(corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir))
    want = brute.near_components(ROWS)
    assert sorted(r[0] for r in out.elements() if r[0] is not None) == sorted(set(want.values()))
    assert set(out) <= set(ROWS)


def test_contaminated_documents_go(spark, docs, sf_dir):
    out = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    windows = {tuple(w[i : i + 13]) for _, t in ITEMS for w in [brute.fold_words(t)] for i in range(len(w) - 12)}
    held = lambda t: any(tuple(w[i : i + 13]) in windows for w in [brute.fold_words(t)] for i in range(len(w) - 12))
    assert rows(out) == Counter(r for r in ROWS if not held(r[1]))
    assert out.count() < len(ROWS)


def test_mix(spark, docs, sf_dir):
    out = rows(corpus_pipeline.mix_sources(spark, docs, sf_dir))
    assert set(out) <= set(ROWS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    n = Counter(ROWS)
    for s, (_, target) in brute.mix_targets(ROWS).items():
        own = [r for r in n if r[3] == s]
        assert abs(sum(words(r[1]) * out[r] for r in own) - target) <= max(words(r[1]) * n[r] for r in own)
        assert all(out[r] <= 2 * n[r] for r in own)


def test_shards(spark, docs, sf_dir):
    out = corpus_pipeline.shard_corpus(spark, docs, sf_dir).collect()
    assert Counter((-(2**63) if r["doc_id"] is None else r["doc_id"], r["size"], r["shard"], r["slot"]) for r in out) == brute.shards(ROWS)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    kept = {r[0]: r for r in ROWS}
    assert got and all(r["text"] == kept[r["doc_id"]][1] for r in got if r["doc_id"] is not None)
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert max(slots.values()) == 1
    again = rows(corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard"))
    assert again == Counter((r["doc_id"], r["shard"]) for r in got)
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
