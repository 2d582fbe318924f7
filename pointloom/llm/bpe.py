"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix ends in one token only, so that one number per prefix is enough: an
automaton gives all tokens that a prefix ends in, and that one is its last token which stays apart
from the last token of what is before it. Following these tokens back from the end gives the ids.
Two neighbours stay apart if, through the whole history of merges, no rule joins the pieces that
face each other at their border.

Texts are cut into words as the tokenizer's file says. What the file asks for goes through its
library's normaliser and pre-tokeniser; for texts below U+0300 the usual steps are done here, and what a
worker has encoded between two spaces it looks up.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

#: Stands for the end of a word in the automaton; byte-level letters are never control characters.
END = "\n"
#: Words and pairs that a worker remembers; what it has seen is forgotten at that size.
MEMORY = 400_000
#: Text that the quick steps don't take: from U+0300 on, and the separators that only Python takes for white space.
_WIDE = re.compile("[^\x00-\x1b\x20-\u02ff]")
# The normaliser and pre-tokeniser that have quick steps.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


_WORDS = regex.compile(_PATTERN)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else from U+0100 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Remembers what f gave, up to MEMORY entries."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        out = self[key] = self.f(key)
        return out


class Vocabulary:
    """Tokens, merge rules and text steps of a tokenizer's JSON file (a byte-level BPE model)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        whole = json.loads(spec)
        model = whole["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE model is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.letters = byte_letters()
        if any(letter + self.suffix not in self.ids for letter in self.letters.values()):
            raise ValueError("a byte has no token")
        self._merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self._build()
        self.library = Tokenizer.from_str(spec)
        # words then lie between white space and can be told apart in each run of other characters alone
        self.quick = (whole["normalizer"], (whole["pre_tokenizer"] or {}).get("pretokenizers")) == (_NORMALIZER, _CUT)
        self.words = _Memo(lambda word: _packed(self.word(word)))
        self.runs = _Memo(self._run)
        self.apart = _Memo(lambda pair: self._apart(*pair, math.inf))

    def _merges(self, merges: list) -> None:
        self.rules, self.parts, self.born = {}, {}, dict.fromkeys(self.ids.values(), -1)
        for rank, (a, b) in enumerate(merges):
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            if made in self.parts:
                raise ValueError(f"two rules make {a + b}")
            self.rules[left, right] = rank
            self.parts[made], self.born[made] = (left, right), rank

    def _edge(self, token: int, side: int, dies: float):
        """The pieces at a token's left (0) or right (1) edge, latest first, each with the rank that ends it."""
        while True:
            yield token, dies
            if token not in self.parts:
                return
            dies = self.born[token]
            token = self.parts[token][side]

    def _apart(self, a: int, b: int, before: float) -> bool:
        """No rule below rank before joins the pieces that face each other between a and b.

        Of equal ranks the place further left goes first: a merge within b comes after the border, one within a before it.
        """
        for p, p_dies in self._edge(a, 1, before):
            for q, q_dies in self._edge(b, 0, before):
                rank = self.rules.get((p, q), math.inf)
                if rank < p_dies and rank <= q_dies and rank < before:
                    return False
                if q_dies < self.born[p]:
                    break  # older pieces were gone when p came to be
        return True

    def _build(self) -> None:
        """The automaton of all tokens that encode as themselves; tokens come after their parts."""
        self.find, self.size = ahocorasick.Automaton(), {}
        alone = set()
        single = {letter + end for letter in self.letters.values() for end in ("", self.suffix)}
        for text, token in sorted(self.ids.items(), key=lambda x: self.born[x[1]]):
            if token in self.parts:
                a, b = self.parts[token]
                if a not in alone or b not in alone or not self._apart(a, b, self.born[token]):
                    continue
            elif text not in single:
                continue
            alone.add(token)
            ends = self.suffix and text.endswith(self.suffix)
            key = text[: -len(self.suffix)] + END if ends else text
            self.find.add_word(key, (token, len(key)))
            self.size[token] = len(key)
        self.find.make_automaton()

    def word(self, word: str) -> list[int]:
        """Ids of one word in byte letters."""
        text = word + END if self.suffix else word
        last: list[int | None] = [None] * len(text) + [-1]  # what stands at index -1 is before the text
        apart = self.apart
        for at, (token, size) in self.find.iter(text):
            if last[at] is None and (before := last[at - size]) is not None and (before < 0 or apart[before, token]):
                last[at] = token
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def _run(self, run: str) -> bytes:
        """Ids of a text below U+0300 without white space."""
        words = _WORDS.findall(run.lower())
        if not (run.isascii() and run.isprintable()):
            words = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return b"".join(map(self.words.__getitem__, words))

    def _part(self, text: str) -> bytes:
        if self.quick and not _WIDE.search(text):
            return b"".join(map(self.runs.__getitem__, text.split()))
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return b"".join(self.words[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; strings of special tokens are these tokens."""
        if self.special is None:
            return self._part(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(_packed([self.specials[part]]))
            elif part:
                out.append(self._part(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; without a decoder in the file, tokens joined by spaces."""
        tokens = [self.names[i] for i in ids if i in self.names]
        return self.library.decoder.decode(tokens) if self.library.decoder else " ".join(tokens)


_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(key: str, spec: str) -> Vocabulary:
    """One a worker and file."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


class Bpe:
    """Column functions of a tokenizer's file; the file (a few MB) is read here and sent to the executors.

    encode(text) -> array<int>: the ids, no special tokens added, nothing cut or padded. Null and
    empty texts, and such of white space only, have none. decode(ids) -> string: null for null.
    pack(ids) -> binary: little-endian unsigned 32-bit numbers; null for null.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        Vocabulary(spec)  # an unfit file is an error here, not in a task
        shared, key = spark.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest()

        def encode(texts: pa.Array) -> pa.Array:
            v = _vocabulary(key, shared.value)
            packed = [v.encode(t.as_py() or "") for t in texts]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))

        def decode(ids: pa.Array) -> pa.Array:
            v = _vocabulary(key, shared.value)
            return pa.array([None if x.as_py() is None else v.decode(x.values.to_pylist()) for x in ids], pa.string())

        def pack(ids: pa.Array) -> pa.Array:
            return pa.array([None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for x in ids], pa.binary())

        def digests(texts: pa.Array) -> pa.Array:
            v, out = _vocabulary(key, shared.value), []
            for text in texts:
                ids = v.encode(text.as_py() or "")
                decoded = v.decode(np.frombuffer(ids, "<u4").tolist())
                out.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()})
            return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

        self._digests = F.arrow_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
        self._encode, self._decode, self._pack = F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "string"), F.arrow_udf(pack, "binary")

    def encode(self, text: Column) -> Column:
        return self._encode(text.cast("string"))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def pack(self, ids: Column) -> Column:
        return self._pack(ids)

    def digests(self, text: Column) -> Column:
        """Struct of n_tokens, ids_sha256 (of the packed ids) and decoded_sha256 (of what they decode to)."""
        return self._digests(text.cast("string"))


def tokenized(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of their whole texts as an array column.

    Rows and columns stay, repeated rows and nulls included; a column of ids_col's name is
    replaced. An empty table gives an empty one. One narrow pass: nothing is shuffled.
    """
    return docs.withColumn(ids_col, Bpe(docs.sparkSession, path).encode(col(text_col)))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_tokens, ids_sha256 (of the packed ids) and decoded_sha256.

    Null texts count as empty; ids keep their type and may be null or repeat. Other columns are ignored.
    """
    return docs.select(col(id_col), Bpe(docs.sparkSession, path).digests(col(text_col)).alias("d")).select(col(id_col), "d.*")
