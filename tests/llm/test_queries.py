"""Each query over the whole small tables against its brute-force version or SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from pointloom.llm import queries as q
from pointloom.llm.sql import oracle_sql

from . import brute


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twin(spark, sf, con, name):
    got = q.queries()[name](spark, sf)
    want = con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted([tuple(r[c] for c in cols) for r in got.collect()], key=repr)
    b = sorted([tuple(v for _, v in sorted(zip(want.columns, r))) for r in want.fetchall()], key=repr)
    assert a == b


def test_simhash(spark, sf, texts):
    prints = {i: brute.simhash(t) for i, t in texts.items()}
    label = brute.components(sorted(prints.items()))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in texts}


def test_langid(spark, sf, con):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = q.op2_langid(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    docs = con.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()
    train = [(t, x) for i, t, x in docs if zlib.crc32(str(i).encode()) % 5 and t is not None and x is not None]
    want = brute.language(train, [t or "" for _, t, _ in docs])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    for (i, _, _), (x, score) in zip(docs, want):
        assert got[i][0] == x and abs(got[i][1] - score) < 1e-6


def test_audio(spark, sf, texts):
    for r in q.op7_audio(spark, sf).collect():
        data = texts[r["doc_id"]].encode()
        full = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(full[-32:])
        size = len(full)
        head = b"RIFF" + (36 + size).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0, 128, 62, 0, 0, 128, 62, 0, 0, 1, 0, 8, 0]) + b"data" + size.to_bytes(4, "little")
        assert r["media_bytes"] == 44 + size and r["media_sha256"] == hashlib.sha256(head + full).hexdigest()
        rate, frames, count, active, mel = brute.audio_feature(full)
        parts = dict(p.split("=") for p in r["feature"].split(";"))
        assert (int(parts["rate"]), int(parts["frames"])) == (rate, frames)
        # a level within rounding of a threshold may fall to either side
        assert abs(int(parts["segments"]) - count) <= 1 and abs(int(parts["active"]) - active) <= 1 + frames // 100
        assert np.abs(np.array(parts["mel"].split(","), float) - mel).max() < 0.02


def test_decontam(spark, sf, con):
    """Every verbatim item is found; nothing else that shares no half of an item."""
    import re

    tok = lambda s: re.findall(r"\w+", s.lower())
    items = {i: tok(t) for i, t in con.sql("SELECT item_id, text FROM benchmark").fetchall()}
    docs = {i: tok(t) for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    grams = {i: {tuple(w[k : k + 6]) for k in range(len(w) - 5)} for i, w in docs.items()}
    want = {(d, i) for d in docs for i, w in items.items() if sum(tuple(w[k : k + 6]) in grams[d] for k in range(len(w) - 5)) > (len(w) - 5) / 2}
    assert {(r["doc_id"], r["item_id"]) for r in q.op8_decontam(spark, sf).collect()} == want


def test_secrets(spark, sf, texts):
    got = {r["doc_id"]: r for r in q.op9_secrets(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        counts, digest, joined = brute.secrets(text)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == counts and r["base_sha256"] == digest
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_quality(spark, sf, con):
    want = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = q.op10_quality(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in want]
    assert sum(r["predicted"] == want[r["doc_id"]] for r in held) >= 0.85 * len(held)


def test_quality_against_brute_force(spark, sf, con, texts):
    """Features, label join, fit and score of every document; the tables' labels are fewer than a fit may use."""
    labels = [r for r in con.sql("SELECT doc_id, quality FROM labels").fetchall() if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    want = brute.quality_scores(texts, labels)
    got = {r["doc_id"]: r["score"] for r in q.op10_quality(spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_chat_moves_turns_once(spark, sf):
    """One exchange by ranges of turns, one by conversation."""
    plan = q.op3_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1 and plan.count("hashpartitioning(") == 1


def test_mix_comes_near(spark, sf):
    rows = q.op5_mixing(spark, sf).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2
        assert target <= 3 * size + 1e-6
    assert abs(sum(t for _, t in by) - sum(r["size"] for r in rows)) < 1


def test_pipeline(spark, sf, texts, con):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    kept = None
    for name, stage in p.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = p.materialize(stage(spark, docs, sf), f"test-{name}")
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "quality":
            assert sum(labels.get(i) == 0 for i in after) <= 2 and sum(labels.get(i) == 1 for i in set(before) - set(after)) <= 2
        elif name == "near_duplicates":
            assert set(after) == set(brute.jaccard_components(before).values())
        elif name == "decontamination":
            assert all(before[i] == after[i] for i in after)
            stage_con = duckdb.connect()
            stage_con.register("documents", docs.select("doc_id", "text").toArrow())
            stage_con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
            assert set(before) - set(after) == {r[0] for r in stage_con.sql(f"SELECT DISTINCT doc_id FROM ({oracle_sql()['op8_decontam']})").fetchall()}
        elif name == "mixing":
            stage_con = duckdb.connect()
            stage_con.register("documents", docs.toArrow())
            taken = stage_con.sql(f"SELECT doc_id, taken FROM ({oracle_sql()['op5_mixing']}) WHERE taken > 0").fetchall()
            assert sorted(taken) == sorted((r["doc_id"], r["taken"]) for r in out.collect())
        elif name == "secrets":
            assert set(after) == set(before)
            for i, text in before.items():
                joined = brute.secrets(text)[2]
                assert (after[i] == text) == (not joined) or "[SECRET]" in after[i]
                assert not joined or "[SECRET]" in after[i]
        docs, kept = out, after
    assert kept
    assert p.run(spark, sf).select("doc_id", "taken").orderBy("doc_id").collect() == docs.select("doc_id", "taken").orderBy("doc_id").collect()
