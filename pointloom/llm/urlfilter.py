"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact join.

A listed entry is host + path, for example `example.org/es/`, and covers its host, all
subdomains and all paths that start with its path. The filter has the entries and their hosts.
A URL's probes are first the last labels of its host; those that pass are joined to the
list's hosts, which tells how long their listed paths are, and the path's prefixes of these
lengths are probed in turn. What passes is joined to the list by host and path, so that
false positives drop out. Rules are compared with the URL as it stands, other entries with
its canonical form: no user, port or dot after the host, `/` for an empty path, in a path no
`.` and `..` segments, letters, digits and `-._~` unescaped and other escapes in upper case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, materialize, mix64

#: A block is a cache line of eight words; a key sets a bit in each.
WORDS = 8
BITS_PER_KEY = 16
#: The filter is at most this large; with more entries it lets more pass, and the join decides.
MAX_BLOCKS = 1 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def _unescaped(path: Column) -> Column:
    """Escapes of characters that need none undone, the hexadecimal digits of others in upper case."""

    def one(part: Column, k: Column) -> Column:
        letter = F.char(F.conv(F.substring(part, 1, 2), 16, 10).cast("bigint"))
        free = F.when(letter.rlike(r"\A[A-Za-z0-9._~-]\z"), letter).otherwise(F.concat(F.lit("%"), F.upper(F.substring(part, 1, 2))))
        escape = F.when(part.rlike(r"\A[0-9A-Fa-f]{2}"), F.concat(free, part.substr(F.lit(3), F.length(part)))).otherwise(F.concat(F.lit("%"), part))
        return F.when(k == 0, part).otherwise(escape)

    return F.array_join(F.transform(F.split(path, "%", -1), one), "")


def _straight(path: Column) -> Column:
    """Segments `.` left out, `..` with the segment before; one at the end leaves a slash."""

    def step(held: Column, part: Column) -> Column:
        back = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(part == ".", held).when(part == "..", back).otherwise(F.concat(held, F.array(part)))

    parts = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))  # a path begins with a slash
    joined = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.\.?\z") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def canonical_path(path: Column) -> Column:
    """A URL's path, which is empty or begins with a slash; paths without escapes and dot segments cost two searches."""
    plain = F.when(path.contains("%"), _unescaped(path)).otherwise(path)
    return F.when(path == "", "/").when(plain.rlike(r"/\.\.?(/|\z)"), _straight(plain)).otherwise(plain)


def _slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each 64-bit hash and its bit in each of the block's words."""
    h = mix64(h.view(np.uint64))
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    bits = mix64(h + np.uint64(1))
    return block.astype(np.int64), [np.uint64(1) << ((bits >> np.uint64(6 * i)) & np.uint64(63)) for i in range(WORDS)]


def build_filter(keys: DataFrame, n: int) -> np.ndarray:
    """Filter of the hashes in column h: an array (blocks, WORDS), of bounded size."""
    blocks = int(min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))))

    def fill(batches):
        for batch in batches:
            own = np.zeros((blocks, WORDS), np.uint64)
            block, bits = _slots(batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64), blocks)
            for i, b in enumerate(bits):
                np.bitwise_or.at(own[:, i], block, b)
            used = np.flatnonzero(own.any(axis=1))
            yield pa.RecordBatch.from_pydict({"block": pa.array(used, pa.int64())} | {f"w{i}": pa.array(own[used, i].view(np.int64)) for i in range(WORDS)})

    names = [f"w{i}" for i in range(WORDS)]
    parts = keys.select("h").mapInArrow(fill, "block long, " + ", ".join(f"{w} long" for w in names))
    rows = parts.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in names)).toArrow()  # a row per block at most
    out = np.zeros((blocks, WORDS), np.uint64)
    if rows.num_rows:
        at = rows.column("block").to_numpy()
        for i, w in enumerate(names):
            out[at, i] = rows.column(w).to_numpy().view(np.uint64)
    return out


def may_contain(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, bits = _slots(h, len(table))
    hit = np.ones(len(h), bool)
    for i, b in enumerate(bits):
        hit &= (table[block, i] & b) != 0
    return hit


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages plus host, path, entry, entry_kind and verdict.

    listed has host, path, verdict and kind (strings); entries of kind `rule` go before others,
    then the longest host + path wins, then `block`. entry is the winner's host + path, null for
    none, and verdict its verdict, else default. Null URLs and such without :// have an empty
    host and path and fit no entry. Repeated rows repeat. Columns of those names are replaced;
    an empty list gives the default everywhere.
    """
    pages = pages.drop("host", "path", "entry", "entry_kind", "verdict")
    listed = listed.select("host", "path", "verdict", "kind").where("host IS NOT NULL AND path IS NOT NULL AND host <> ''").distinct()
    hosts = listed.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    n, labels = listed.agg(F.count("*"), F.max(F.size(F.split("host", r"\.", -1)))).first()
    keys = listed.select(F.xxhash64("host", "path").alias("h")).unionByName(hosts.select(F.xxhash64("host").alias("h")))
    shared = pages.sparkSession.sparkContext.broadcast(build_filter(keys, 2 * n))

    def passes(h: pa.Array) -> pa.Array:
        return pa.array(may_contain(shared.value, h.to_numpy(zero_copy_only=False).astype(np.int64)))

    may = F.arrow_udf(passes, "boolean")
    url = col(url_col).cast("string")
    urls = pages.select(url.alias("u")).where(F.col("u").contains("://")).withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    form = lambda host, path, literal, canonical: F.struct(host.alias("host"), path.alias("path"), literal.alias("literal"), canonical.alias("canonical"))
    host, path = canonical_host(F.col("host")), canonical_path(F.col("path"))
    plain = (host == F.col("host")) & (path == F.col("path"))
    forms = F.when(plain, F.array(form(F.col("host"), F.col("path"), F.lit(True), F.lit(True))))
    forms = forms.otherwise(F.array(form(F.col("host"), F.col("path"), F.lit(True), F.lit(False)), form(host, path, F.lit(False), F.lit(True))))
    probes = urls.select("u", F.explode(forms).alias("f")).select("u", "f.*").withColumn("labels", F.split("host", r"\.", -1))
    upto = F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(labels or 1)))
    tails = F.transform(upto, lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."))
    probes = probes.select("u", "path", "literal", "canonical", F.explode(tails).alias("tail")).where(may(F.xxhash64("tail"))).distinct()
    probes = probes.join(hosts.withColumnRenamed("host", "tail"), "tail")
    fitting = F.filter("lengths", lambda m: m <= F.length("path"))
    probes = probes.select("u", "tail", "literal", "canonical", F.explode(F.transform(fitting, lambda m: F.col("path").substr(F.lit(1), m))).alias("start"))
    hits = probes.where(may(F.xxhash64("tail", "start")))
    fits = (hits["tail"] == listed["host"]) & (hits["start"] == listed["path"]) & F.when(F.col("kind") == "rule", F.col("literal")).otherwise(F.col("canonical"))
    key = F.concat("tail", "start")
    rank = F.struct((F.col("kind") == "rule").cast("int").alias("is_rule"), F.length(key).alias("len"), (F.col("verdict") == "block").cast("int").alias("blocks"), key.alias("key"), "verdict", "kind")
    best = hits.join(listed, fits).groupBy("u").agg(F.max(rank).alias("best"))
    mark, win = free_name(pages, "judged_url"), free_name(pages, "winner")
    # written, so that the last join has plain exchanges on both sides: a hot url, or null, can be split
    best = materialize(best.select(F.col("u").alias(mark), F.col("best").alias(win)), "url-verdicts")
    out = pages.join(best, url == F.col(mark), "left").drop(mark)
    out = out.withColumns({"host": host_of(url), "path": path_of(url), "entry": F.col(f"{win}.key"), "entry_kind": F.col(f"{win}.kind"), "verdict": F.coalesce(f"{win}.verdict", F.lit(default))})
    return out.drop(win)
