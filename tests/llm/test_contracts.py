"""The digest queries of trained and hand-ruled operators against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import os
import pickle
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from tarnwick.llm import langid, pii, secrets, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def crc(i, m: int) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


@pytest.fixture(scope="module")
def known():
    import duckdb

    return {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, text, lang, toxic FROM '{SF}/documents.parquet' LEFT JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()}


@tables
def test_languages_of_held_out_documents(spark, known):
    rows = {r["doc_id"]: r for r in langid.op2_langid(spark, SF).collect()}
    assert set(rows) == set(known) and all(r["held_out"] == (crc(i, 4) == 2) for i, r in rows.items())
    learned = {k for i, (_, k, _) in known.items() if k and crc(i, 4) != 2}
    assert {r["lang_pred"] for r in rows.values()} <= learned | {"und"} and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i, (_, k, _) in known.items() if k and crc(i, 4) == 2]
    assert np.mean([rows[i]["lang_pred"] == known[i][1] for i in held]) >= 0.97


def test_a_language_is_predicted_as_by_hand():
    """The machines' answer from a plain sum over byte grams, a vote at a time."""
    r = random.Random(4)
    bits = {"en": ["the", "ing", "wh"], "de": ["sch", "ung", "ü"], "fr": ["eau", "que", "é"], "es": ["ción", "ñ", "rr"], "pt": ["ção", "lh", "ões"]}
    make = lambda k, n: " ".join("".join(r.choice(bits[k]) for _ in range(3)) for _ in range(n))
    model = langid.Model([(k, make(k, 40).encode()) for k in bits for _ in range(12)])
    for k in bits:
        for _ in range(10):
            text = make(k, 25)
            x = langid.features(text.encode())
            tops = {f: float(model.matrix[model.top[n]] @ x) for n, (f, _) in enumerate(model.families)}
            own = dict(model.families)[max(tops, key=tops.get)]
            votes = {c: 0 for c in own}
            for (a, b), n in model.pairs.items():
                if a in votes:
                    votes[a if float(model.matrix[n] @ x) >= 0 else b] += 1
            assert model.predict(text.encode())[0] in {c for c in own if votes[c] == max(votes.values())}


@tables
def test_toxicity_of_held_out_documents(spark, known):
    rows = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, SF).collect()}
    assert set(rows) == set(known) and all(r["held_out"] == (crc(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in rows.items())
    labels = {i: y for i, (_, _, y) in known.items() if y is not None and crc(i, 3) == 1}
    assert sum(rows[i]["predicted"] for i, y in labels.items() if not y) <= 2
    assert sum(rows[i]["predicted"] for i, y in labels.items() if y) >= 0.4 * sum(labels.values())
    sample = toxicity.sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "toxic", "lang", lambda c: toxicity.crc_mod(c, 3) != 1)
    assert sample and all(crc(i, 3) != 1 and known[i][2] == y for i, _, y, _ in sample)


def test_a_score_is_what_a_plain_convolution_gives():
    r = random.Random(5)
    rows = [(k, (brute.prose(r, r.randint(3, 20)) + (" vilox" if k % 3 == 0 else "")).encode(), int(k % 3 == 0)) for k in range(150)]
    made = toxicity.trained(rows)
    kept: list = []
    for f, net in enumerate(made.nets):
        again = toxicity.Net(5 + f)
        own = [toxicity.units(t, toxicity.Buckets()) for _, t, _ in rows]
        again.train([(own[i], rows[i][2]) for i in range(len(rows)) if i % toxicity.FOLDS != f], 6 + f)
        kept.append(again)
    for text in (b"", b"vilox", b"an er vilox la ti", rows[1][1], rows[3][1]):
        own = toxicity.units(text, toxicity.Buckets())
        raw = []
        for net in kept:
            vec = [net.e[a] + net.e[b] for a, b in own] + [net.e[0] * 2] * toxicity.PAD
            pooled = [max(sum(float(vec[s + j] @ net.w[k][j][:, f]) for j in range(k)) for s in range(len(own))) for k in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
            raw.append(float(np.maximum(np.array(pooled) + net.b, 0) @ net.v + net.c[0]))
        want = toxicity.sigmoid(np.array([np.mean(raw) + made.shared]))[0]
        assert abs(made.scores([text], toxicity.Buckets())[0] - want) < 1e-4


def test_awkward_texts_are_scored(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \n"), (None, "x"), (4, "w " * 40_000)]
    made = toxicity.trained([(k, f"a{k % 7} b{k % 5} {'bad' if k % 2 else 'ok'}".encode(), k % 2) for k in range(60)])
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as score", "7 as other"), made).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1 and all(r["other"] == 7 for r in got)


def test_the_classifier_is_trained_on_an_executor_and_comes_back_small(spark, tmp_path, monkeypatch):
    r, driver, plain = random.Random(8), os.getpid(), toxicity.trained
    docs = [(k, None if k == 7 else brute.prose(r, r.randint(3, 20)) + (" vilox" if k % 3 == 0 else ""), "en" if k % 2 else "fr") for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = plain([(k, (t or "").encode(), int(k % 3 == 0), lang) for k, t, lang in docs if crc(k, 3) != 1])

    def elsewhere(rows):
        assert os.getpid() != driver, "texts and layers are in the driver's memory"
        return plain(rows)

    monkeypatch.setattr(toxicity, "trained", elsewhere)
    made = toxicity.model_of(spark, str(tmp_path))
    texts = [(t or "").encode() for _, t, _ in docs]
    assert len(pickle.dumps(made)) < 3 * toxicity.BUCKETS * toxicity.DIM * 4 + 1_000_000  # the embeddings of three nets, without the tables made of them
    assert np.allclose(made.scores(texts, toxicity.Buckets()), want.scores(texts, toxicity.Buckets()), atol=1e-5)
    spark.createDataFrame([], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.model_of(spark, str(tmp_path)) is None


# The contract's three patterns, written out by hand.
ASSIGN = re.compile("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def base_secrets(text: str) -> dict:
    return {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12], "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 18], "hex": [m.span() for m in HEX.finditer(text) if len(m[0]) >= 16]}


@tables
def test_secrets_by_the_patterns_of_the_contract(spark, known):
    order = ["assign", "access", "hex"]
    for r in secrets.op8_secrets(spark, SF).collect():
        own = base_secrets(known[r["doc_id"]][0] or "")
        assert [r[f"n_{k}"] for k in order] == [len(own[k]) for k in order]
        spans = sorted((s, order.index(k), e) for k in order for s, e in own[k])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{order[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert {f"{order[k]}:{s}:{e}" for s, k, e in spans} <= set(r["spans"].split(","))


def test_the_field_is_decoded_as_by_trying_all_segmentations():
    """The dynamic programme's segmentation scores what the best of all choices of candidates does, found by plain recursion."""
    field, tried = pii.trained(), 0
    for text in ("mail jan at host.net now", "call 555-123-4567", "+44 20 7946 0958 or so", "a@b.org, 10.0.0.1", "no data here"):
        tok = pii.tokens_of(text, 0, len(text))
        segs, n = pii.candidates(tok), len(tok)
        if not segs or n > 14:
            continue
        at: dict[int, list] = {}
        for j, ends in enumerate(field._ends(n, segs)):
            for i, own, _ in ends:
                at.setdefault(i, []).append((j, own))

        def best(i: int, before: int) -> float:
            if i == n:
                return 0.0
            out = float(field.t[before][0]) + best(i + 1, 0)
            for j, own in at.get(i, []):
                for y in range(1, len(pii.KINDS) + 1):
                    out = max(out, float(field.t[before][y]) + float(own[y - 1]) + best(j, y))
            return out

        total, k, before = 0.0, 0, 0
        for i, j, y in [*field.decode(n, segs), (n, n, -1)]:
            while k < i:
                total, k, before = total + float(field.t[before][0]), k + 1, 0
            if y >= 0:
                total += float(field.t[before][y + 1]) + next(float(own[y]) for e, own in at[i] if e == j)
                k, before = j, y + 1
        assert abs(total - best(0, 0)) < 1e-6
        tried += 1
    assert tried >= 3
