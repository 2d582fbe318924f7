"""Queries over the test tables: each applies one operator with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, chat, decontam, langid, merkle, mixing, quality, secrets, simhash, spelling, substring, urlfilter
from .common import fold_mod, table

# The rules of the URL query, and the listed hosts behind them.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
URL_NAMES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
URL_LISTED = tuple((f"{name}.example.{top}", "/") for name in URL_NAMES for top in ("com", "net", "org"))

#: Columns of a document that its leaf in the manifest hashes.
MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")
#: Vocabulary of the encoding query.
BPE_FILE = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, held_out=(5, 0))
    return got.select("doc_id", (langid.fold_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(chat.events_of(log.unionByName(extra)), dealt=True))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(h, p, v, "rule") for h, p, v in URL_RULES] + [(h, p, "block", "list") for h, p in URL_LISTED]
    listed = spark.createDataFrame(entries, "host string, path string, verdict string, kind string")
    got = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return got.select("page_id", "host", "path", F.when(F.col("entry_kind") == "rule", F.col("entry")).alias("rule"), "verdict")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.analysed(table(spark, sf_dir, "documents")).drop("tensors")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.classify(docs, table(spark, sf_dir, "labels"), held_out=(4, 2))
    return got.select("doc_id", (quality.fold_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, {"n_chars": F.col("n_chars") + 1}, fold_mod(F.col("doc_id"), 7) == 0, "lang", "doc_id", MANIFEST)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(spelling.occurrences(docs)))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BPE_FILE))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_langid, op3_chat, op4_substring, op5_mixing, op6_urls, op7_audio, op8_decontam, op9_secrets, op10_quality, op11_merkle, op12_spelling, op13_bpe)}
