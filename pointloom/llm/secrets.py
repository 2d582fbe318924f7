"""Secret scanning with an incremental ledger of blobs, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its contents. Only pairs of a blob
and a rule version that the ledger doesn't hold are scanned; findings are kept per blob
and joined back to every path that has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, folder, free_name, materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str  # Java syntax; matches are leftmost and don't overlap
    least: int  # characters that `group` must have
    group: int = 0


# A private key from its BEGIN to its END line, whatever stands between but another BEGIN or END;
# where END is missing, to the last of the header and base64 lines. Breaks may be written as \n.
_BREAK = r"(?:[\s>]|\\[nrt])"
_PEM = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_BREAK}*+[A-Za-z][A-Za-z0-9-]*+: [^\r\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_BREAK}++=?[A-Za-z0-9+/]{{1,15}}={{0,2}}(?![^\s\\\"'<]))?"
    r")?"
)
# The base kinds in their order, then those that the method adds.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),
    Rule("pem", 2, _PEM, 1),
    # from the start of a run of its characters and without going back: linear on any text
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 1),
    Rule("ghtoken", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 1),
)
#: Spans up to these bytes (100 a blob, 40 a span) go to every executor for redaction; with more
#: of them the texts are shuffled by blob.
BROADCAST_BYTES = 32 << 20
#: Characters of a block in which spans are replaced, and what stands for a span.
BLOCK, MARK = 4096, "[SECRET]"
BASE = ("assign", "access", "hex")
#: File that ends a committed version of a ledger.
WHOLE = "_WHOLE"
FINDINGS = "blob string, kind string, rule_version int, start long, end long"


def blob_of(text: Column) -> Column:
    """Content address; null texts are the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rule_rows(text: Column, rule: Rule) -> Column:
    """Array of (before, length, enough) of a rule's matches: characters since the last match, its own."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    graded = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(parts.alias("part"), found.alias("match"), graded.alias("graded"))
    rows = F.transform(zipped, lambda z: F.struct(F.length(z["part"]).cast("long").alias("before"), F.length(z["match"]).cast("long").alias("len"), (F.length(z["graded"]) >= rule.least).alias("enough")))
    none = F.array().cast("array<struct<before:bigint,len:bigint,enough:boolean>>")
    return F.when(text.rlike(rule.pattern), rows).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of blobs (blob, text, seen): one row per kept match, offsets in code points, end exclusive.

    Bit k of seen leaves out rule k. Matches that are too short are dropped only after matching
    went on behind them.
    """
    none = F.array().cast("array<struct<before:bigint,len:bigint,enough:boolean>>")
    new = lambda k: F.col("seen").bitwiseAND(F.lit(1 << k)) == 0
    per_rule = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), F.when(new(k), _rule_rows(F.col("text"), r)).otherwise(none).alias("rows")) for k, r in enumerate(rules)))
    rows = blobs.select("blob", F.explode(per_rule).alias("r")).where(F.size("r.rows") > 0)
    rows = rows.select("blob", "r.kind", "r.rule_version", F.posexplode("r.rows").alias("at", "m"))
    # a window holds the matches of one kind in one text
    upto = Window.partitionBy("blob", "kind").orderBy("at")
    end = F.sum(F.col("m.before") + F.col("m.len")).over(upto)
    rows = rows.select("blob", "kind", "rule_version", end.alias("end"), "m.len", "m.enough")
    return rows.where("enough").select("blob", "kind", "rule_version", (F.col("end") - F.col("len")).alias("start"), "end")


def _bit(rules: tuple[Rule, ...]) -> Column:
    """Bit of the rule in force of a ledger row (kind, rule_version), 0 for any other rule."""
    is_rule = [(F.col("kind") == r.kind) & (F.col("rule_version") == r.version) for r in rules]
    return F.coalesce(*(F.when(c, F.lit(1 << k)) for k, c in enumerate(is_rule)), F.lit(0))


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, seen) of the distinct blobs that the ledger doesn't hold under all rules; bit k of seen: under rule k."""
    blobs = blobs.select("blob").distinct()
    if ledger is None:
        return blobs.withColumn("seen", F.lit(0))
    held = ledger.withColumn("bit", _bit(rules)).where("bit > 0").groupBy("blob").agg(F.bit_or("bit").alias("held"))
    out = blobs.join(held, "blob", "left").select("blob", F.coalesce("held", F.lit(0)).alias("seen"))
    return out.where(F.col("seen") != (1 << len(rules)) - 1)


def scan(versions: DataFrame, path_cols: list[str], text_col: str = "text", ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan every version of every path; returns (paths, ledger, findings), stored in the shared folder.

    paths has path_cols and blob, a row per input row; ledger (blob, kind, rule_version) and
    findings (FINDINGS) contain the earlier ones handed in and what this call added: blobs that
    are new, and old blobs under rules whose version is new. Findings of superseded rules stay as
    history; spans_of() and pieces_of() leave them out. Digests meet the ledger first, and only
    texts that are to be scanned are shuffled, once each. Null texts count as empty; equal
    texts are scanned once, whatever their number; null paths are kept. Other columns of
    versions are ignored. Empty input returns the earlier tables.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    paths = materialize(versions.select(*(col(c) for c in path_cols), blob_of(text).alias(free_name(versions.select(*map(col, path_cols)), "blob"))), "secret-paths")
    blobs = paths.select(F.col(paths.columns[-1]).alias("blob"))
    # empty texts match no rule
    texts = versions.select(blob_of(text).alias("blob"), text.alias("text")).where("text <> ''")
    if ledger is None:
        # equal texts are folded before the shuffle
        new = texts.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("seen", F.lit(0))
    else:
        todo = materialize(unseen(blobs, ledger, rules), "secret-unseen")
        todo = F.broadcast(todo) if 100 * todo.count() <= BROADCAST_BYTES else todo
        new = texts.join(todo, "blob").groupBy("blob").agg(F.any_value("text").alias("text"), F.max("seen").alias("seen"))
    now = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules)))
    added = blobs.distinct().select("blob", now.alias("r")).select("blob", "r.*")
    found = scan_blobs(new, rules)
    ledger = materialize(added if ledger is None else ledger.unionByName(added).distinct(), "secret-ledger")
    return paths, ledger, materialize(found if findings is None else findings.unionByName(found), "secret-findings")


def read_ledger(spark: SparkSession, path: str) -> tuple[int, DataFrame | None, DataFrame | None]:
    """Last committed version of a ledger's folder with its (ledger, findings); 0 and None if there is none.

    A version is a folder with both tables and, written last, a file that says it is whole.
    """
    files, top = folder(spark, path)
    done = [x.getPath() for x in files.listStatus(top)] if files.exists(top) else []
    numbers = [int(p.getName().removeprefix("v")) for p in done if files.exists(p.suffix(f"/{WHOLE}"))]
    if not numbers:
        return 0, None, None
    at = f"{path}/v{max(numbers):08d}"
    return max(numbers), spark.read.parquet(f"{at}/ledger"), spark.read.schema(FINDINGS).parquet(f"{at}/findings")


def commit_ledger(path: str, version: int, ledger: DataFrame, findings: DataFrame) -> None:
    """Write version as the folder's next one; an unfinished write of that number is replaced, a committed one is an error."""
    at = f"{path}/v{version:08d}"
    files, mark = folder(ledger.sparkSession, f"{at}/{WHOLE}")
    if files.exists(mark):
        raise ValueError(f"another run has committed version {version}")
    ledger.write.mode("overwrite").parquet(f"{at}/ledger")
    findings.write.mode("overwrite").parquet(f"{at}/findings")
    files.create(mark, False).close()


def in_force(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the rules as they are now, each once: none of earlier versions or of kinds that were given up."""
    return findings.where(_bit(rules) > 0).distinct()


def spans_of(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob: hits, the array of (start, rank of the kind, kind, end) in that order.

    Only findings of the rules in force count, repeated ones once; an empty table gives an empty one.
    """
    rank = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind")).cast("int")
    return in_force(findings, rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("hits"))


def _is_kind(kind: str):
    return lambda h: h["kind"] == kind


def _joined(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per input row: id, n_assign, n_access, n_hex, base_sha256, spans, found by scan().

    With ledger_path the last committed version of that ledger is read, extended and committed as
    the next one, so that a later run scans only texts that are new, or all under rules that are. Without it the
    ledger is this run's own. Ids keep their type; null texts count as empty. An empty table gives an empty result.
    """
    version, ledger, findings = read_ledger(docs.sparkSession, ledger_path) if ledger_path else (0, None, None)
    paths, ledger, findings = scan(docs, [id_col], text_col, ledger, findings, rules)
    if ledger_path:
        commit_ledger(ledger_path, version + 1, ledger, findings)
    per_blob = spans_of(findings, rules)
    base = F.filter("hits", lambda h: h["kind"].isin(*BASE))
    counts = [F.size(F.filter("hits", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    per_blob = per_blob.select("blob", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("hits")).alias("spans"))
    none = {f"n_{k}": F.lit(0).cast("long") for k in BASE} | {"base_sha256": F.sha2(F.lit("").cast("binary"), 256), "spans": F.lit("")}
    blob = paths.columns[-1]
    # written, so that the last join has plain exchanges on both sides: a blob of many paths can be split
    per_blob = materialize(per_blob.withColumnRenamed("blob", "blob_"), "secret-spans")
    out = paths.join(per_blob, F.col(blob) == F.col("blob_"), "left")
    return out.select(col(id_col), *(F.coalesce(F.col(c), v).alias(c) for c, v in none.items()))


def pieces_of(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob: pieces, a map from the numbers of its blocks of BLOCK characters to what goes there.

    Spans that overlap or touch are one. Each block has sorted (lo, hi, mark), places in the block
    and what stands for them: the mark where a span begins, nothing in the blocks that it goes on in.
    Only findings of the rules in force count, repeated ones once.
    """
    seen = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    spans = in_force(findings, rules).select("blob", "start", "end", (before.isNull() | (F.col("start") > before)).cast("int").alias("new"))
    spans = spans.withColumn("island", F.sum("new").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("blob", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    block = lambda at: F.floor(at / F.lit(BLOCK)).cast("int")
    cut = spans.select("blob", "start", "end", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("k"))
    lo, hi = F.greatest(F.col("start") - F.col("k") * BLOCK, F.lit(0)), F.least(F.col("end") - F.col("k") * BLOCK, F.lit(BLOCK))
    mark = F.when(block(F.col("start")) == F.col("k"), MARK).otherwise("")
    each = cut.groupBy("blob", "k").agg(F.array_sort(F.collect_list(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), mark.alias("mark")))).alias("p"))
    return each.groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("pieces"))


def _cut(text: Column, pieces: Column) -> Column:
    """The text with its pieces put in, block by block: linear in the text, however many there are."""

    def put(block: Column, p: Column) -> Column:
        done = lambda k: F.when(k > 0, F.get(p, k - 1)["hi"]).otherwise(0)
        kept = F.transform(p, lambda h, k: F.concat(F.substring(block, done(k) + 1, h["lo"] - done(k)), h["mark"]))
        return F.concat(F.array_join(kept, ""), F.substring(block, F.element_at(p, -1)["hi"] + 1, F.lit(BLOCK)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.array_join(F.transform(blocks, lambda b, k: F.coalesce(put(b, F.try_element_at(pieces, k)), b)), "")


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced by [SECRET], spans that overlap or touch by one.

    Rows, columns and their order stay; n_chars_col, if present, is set to the new length
    where a text changed. Texts without findings, null ones included, stay as they are.
    """
    key, hits = free_name(docs, "blob"), free_name(docs, "secret_pieces")
    _, _, findings = scan(docs.select(col(text_col)), [], text_col)
    found = materialize(pieces_of(findings).select(F.col("blob").alias(key), F.col("pieces").alias(hits)), "secret-pieces")
    many = F.aggregate(F.map_values(hits), F.lit(0), lambda n, p: n + F.size(p))
    size = found.agg(F.sum(100 + 40 * many).alias("b")).first()["b"] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    marked = docs.withColumn(key, blob_of(col(text_col).cast("string"))).join(found, key, "left")
    new = F.when(F.col(hits).isNull(), col(text_col)).otherwise(_cut(col(text_col), F.col(hits)))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(new.alias(c))
        elif n_chars_col and c == n_chars_col:
            out.append(F.when(F.col(hits).isNull(), col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(col(c))
    return marked.select(*out)
