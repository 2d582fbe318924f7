"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pointloom.llm import queries as q
from pointloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def words_of(docs):
    n = Counter()
    for i, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(n, factor=10):
    out, forms = {}, {}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= factor * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None)
    return out


def found(df):
    rows = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(rows) == len({w for w, _ in rows})
    return dict(rows)


def words(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_query(spark, sf, tmp_path):
    """A part of the table that brute force can take; the SQL twin covers whole tables."""
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 9 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    assert found(q.op12_spelling(spark, str(tmp_path))) == brute(words_of(docs))


@pytest.mark.parametrize("letters", ["ab", "abcé", "aàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿbcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß"])
def test_all_edits(spark, letters):
    """Words around a few stems: every kind of edit at every place, also of letters that share a bit."""
    rnd = random.Random(7)
    n = {}
    for _ in range(12):
        stem = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 12)))
        for _ in range(40):
            w = list(stem)
            for _ in range(rnd.randint(0, 2)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = rnd.choice(letters) if rnd.random() < 0.6 else ""
            n["".join(w)] = int(10 ** rnd.uniform(0.4, 4))
    assert found(spelling.variants(words(spark, n))) == brute(n)


def test_short_words_and_chains(spark):
    n = {"a": 2, "b": 30, "ab": 400, "": 9, "bab": 5000, "babe": 60000, "é": 2}
    assert found(spelling.variants(words(spark, n))) == brute(n)
    chain = {"a" * k: 10**k for k in range(1, 18)}
    got = found(spelling.variants(words(spark, chain)))
    assert got == brute(chain) and {r[1] for r in got.values()} == {"a" * 17}


def test_ties(spark):
    n = {"abcdefg": 2, "abcdefh": 40, "abcdefà": 40, "bcdefg": 40, "abcdefgh": 19}
    assert found(spelling.variants(words(spark, n))) == brute(n)


def test_long_words(spark, monkeypatch):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcd") for _ in range(50_000))
    n = {long: 3, long[:9] + "x" + long[10:]: 90, long[:-1]: 4, long + "d": 5, "y" + long: 6, long[:-1] + "zz": 7, long[::-1]: 8}
    assert found(spelling.variants(words(spark, n))) == brute(n)
    monkeypatch.setattr(spelling, "LONG", 0)
    test_all_edits(spark, "abc")


def test_edges(spark):
    text = "Straße STRAẞE naïveté NAÏVETÉ x" * 50
    docs = [(1, text, "c"), (None, text, "c"), (2, None, None), (3, "", "c"), (4, "z" * 300_000, "c"), (4, "z" * 300_000, "c"), (5, "Wörterbuch " * 40_000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string").withColumns({c: F.lit(1) for c in ("n", "run", "h", "id", "mask")})
    got = found(spelling.variants(spelling.vocabulary(spelling.occurrences(frame))))
    assert got == brute(words_of([d[:2] for d in docs]))
    assert found(spelling.variants(spelling.vocabulary(spelling.occurrences(frame.where("false"))))) == {}
    plain = Counter(r["word"] for r in spelling.occurrences(frame.where("doc_id = 5"), slip=0).collect())
    assert plain == {"wörterbuch": 40_000}
    with pytest.raises(ValueError):
        spelling.variants(words(spark, {"abcdefg": 1}), factor=1)
