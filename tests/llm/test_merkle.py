"""Manifest, proofs and folded roots against a plain tree over all rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pointloom.llm import merkle
from pointloom.llm import queries as q

COLS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    """Root, and per leaf its (place, siblings before, siblings after) of each level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            lo = at // arity * arity
            paths[k].append((nodes[lo:at], nodes[at + 1 : lo + arity]))
        own = [at // arity for at in own]
        nodes = [H(*nodes[lo : lo + arity]) for lo in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity):
    leaves = [(r, H(*map(field, r))) for r in rows]
    groups = {}
    for r, leaf in leaves:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    root, tops = tree([sub[g][0] for g in names], arity)
    out = []
    for g, top in zip(names, tops):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), sub[g][1]):
            bad = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            node = H(*map(field, (*r[:3], r[3] + 1 if r[3] is not None else None, r[4]))) if bad else leaf
            for before, after in path + top:
                node = H(*before, node, *after)
            proof = H(*(x for before, after in path + top for x in before + after))
            out.append((r[0], leaf, sub[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def audited(docs, arity=2):
    from pointloom.llm.common import fold_mod

    got = merkle.audit(docs, {"n_chars": F.col("n_chars") + 1}, fold_mod(F.col("doc_id"), 7) == 0, "lang", "doc_id", COLS, arity)
    return sorted(map(tuple, got.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLS).collect()]
    assert sorted(map(tuple, q.op11_merkle(spark, sf).collect()), key=repr) == brute(rows, 2)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_several_passes(spark, monkeypatch, arity):
    """Blocks of few leaves: subtrees of odd sizes over many passes, null groups, ids and repeated rows."""
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 4)
    sizes = {None: 1, "": 2, "de": 37, "é": 64, "en": 65, "Z": 3}
    rows = [(k * 7 % 50 if k % 11 else None, "s" if k % 3 else None, g, len(str(k)) if k % 5 else None, "t" * k if k % 4 else None) for g, n in sizes.items() for k in range(n)]
    rows += [(5, "s", "en", 4, "same")] * 6
    assert audited(frame(spark, rows), arity) == brute(rows, arity)


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 4)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = [(k, "s", f"l{k % 9}" if k % 9 else None, k, "x") for k in range(120)]
    assert audited(frame(spark, rows)) == brute(rows, 2)


def test_edges(spark):
    assert audited(frame(spark, [])) == []
    one = [(3, None, None, None, None)]
    assert audited(frame(spark, one)) == brute(one, 2)
    rows = [(1, "a", "en", 2, "ü" * 200_000), (1, "a", "en", 2, ""), (None, "a", "en", 2, None)] + [(2, "same", "en", 1, "same")] * 40
    assert audited(frame(spark, rows)) == brute(rows, 2)
    clash = frame(spark, rows).withColumns({c: F.lit(1) for c in ("grp", "node", "at", "many", "claimed", "member", "tie", "c0")})
    assert audited(clash) == brute(rows, 2)
    with pytest.raises(ValueError):
        merkle.trees(frame(spark, rows), 1)


def test_only_tampered_rows_fail(spark, sf):
    for r in q.op11_merkle(spark, sf).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


def test_a_block_s_levels_need_one_exchange(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nodes = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("at"), F.lit(200).cast("long").alias("many"), F.lit(b"x").alias("node"), F.lit(1).alias("member"))
    plan = merkle._pass(nodes, 2, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window [") >= 8
