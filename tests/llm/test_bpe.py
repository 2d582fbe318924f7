"""Encoding by prefixes against the tokenizers library and against merges one at a time."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import bpe
from pointloom.llm import queries as q

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ["", " ", "\n\t", "a" * 3000, "ab" * 2500, "!" * 999, "it's WE'LL 'Tis", "ÉÈ é ß İ Σίσυφος ΟΔΟΣ", "中文字 한글 ٣٤", "\x00\x1c\x85\xa0", "ﬁ Ⅷ ² ①", "a<|endoftext|>b <|startoftext|>", "</w> <|endoftext|", "\U0001f600\U00010d50", "<|endoftext|><|endoftext|>"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    with open(public_tokenizers.path(request.param), encoding="utf-8") as f:
        spec = f.read()
    return bpe.Vocabulary(spec), Tokenizer.from_str(spec)


def ids_of(v, text):
    return np.frombuffer(v.encode(text), "<u4").tolist()


def agree(v, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(v, text) == want
    assert v.decode(want) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(pair):
    for text in ODD:
        agree(*pair, text)


def test_repetitive_words(pair):
    rnd = random.Random(3)
    for _ in range(300):
        agree(*pair, "".join(rnd.choice("aehtin") for _ in range(rnd.randint(1, 200))))


def test_any_text(pair):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=40))
    def run(text):
        agree(*pair, text)

    run()


def test_forgotten_words_change_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    for text in ("the cat and the dog and the bird that sings in the morning", *ODD):
        agree(*pair, text)


def test_against_single_merges():
    """Rules of a made-up model, also such as leave tokens that never come out of their own text."""
    letters = list(bpe.byte_letters().values())
    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("c", "a"), ("a", "a"), ("aa", "a"), ("bc", "bc"), ("ca", "ca"), ("a", "bc")]
    merges = [m for k, m in enumerate(merges) if "".join(m) not in ["".join(x) for x in merges[:k]]]
    vocab = {t: i for i, t in enumerate([*letters, *("".join(m) for m in merges)])}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}}
    v = bpe.Vocabulary(json.dumps(spec))
    assert len(v.size) < len(vocab)  # abc: b and c join first

    def merged(text):
        parts = list(text)
        for a, b in merges:  # every rule's parts come before it
            k = 0
            while k + 1 < len(parts):
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k : k + 2] = [a + b]
                k += 1
        return [vocab[p] for p in parts]

    rnd = random.Random(5)
    for _ in range(2000):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
        assert v.word(text) == merged(text)


def test_unfit_files_are_errors():
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps({"model": {"type": "Unigram"}}))
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps({"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "added_tokens": []}))


def test_query(spark, sf):
    path = public_tokenizers.path(q.BPE_FILE)
    library = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q.op13_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tables(spark):
    path = public_tokenizers.path(q.BPE_FILE)
    library = Tokenizer.from_file(path)
    rows = [(1, None, "x"), (None, "", "y"), (2, "word " * 30_000, None), (2, "word " * 30_000, None), (3, "same", "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = bpe.tokenized(docs, path)
    assert got.columns == ["doc_id", "text", "ids"]
    for r in got.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    back = got.select(bpe.Bpe(spark, path).decode(got["ids"]).alias("back"), "text").collect()
    assert all(r["back"] == library.decode(library.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in back)
    assert bpe.digest(docs, path).count() == 5
    assert bpe.digest(docs.where("false"), path).collect() == []
    other = bpe.Bpe(spark, path)
    assert [tuple(r) for r in spark.sql("SELECT CAST(NULL AS array<int>) AS i").select(other.decode(F.col("i")), other.pack(F.col("i"))).collect()] == [(None, None)]


