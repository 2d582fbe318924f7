"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter that occurs an odd number of times. One inserted, deleted
or replaced letter flips two bits at most, so that of three bands of the mask one stays as it is.
Words meet under equal bands and lengths that differ by one at most, and are verified. Parities
alone say little (over 1,074,182 words of invented prose the bands gave 3 * 10 ** 10 pairs), so a key
also has the half of the word that the edit left alone: with m letters in the shorter word, the
first m // 2 letters agree, or else the last m - m // 2 do. Both rules are exact; no pair is lost.

Letters with a bit are a to z and U+00C0 to U+00FF. Everything is columns and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS, BITS = 3, 20
#: Letters from which on words are compared from their first difference.
LONG = 100
#: Letters a to z, then U+00C0 to U+00FF.
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, slip: int = 31) -> DataFrame:
    """word: a row for each run of letters of every text, A-Z in lower case, of at least so many letters.

    Where slip divides the CRC-32 of `<id>:<run>`, the run lacks the letter at that number modulo its
    length; slip 0 leaves runs as they are. Null texts have no runs, null ids count as empty.
    """
    runs = F.regexp_extract_all(F.translate(col(text_col).cast("string"), UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if slip:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("run"))
    return rows.select(F.col("run").alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """word and n, its number of rows, of words with at least so many; counted within tasks first."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_bits(words: DataFrame) -> list[int]:
    """The mask of each letter of ALPHABET: the most frequent ones are dealt to the bands in turn.

    Letters beyond the number of bits share one; a replacement then flips no bit. What is
    collected are counts of the alphabet's letters.
    """
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    many = {r["letter"]: r["count"] for r in counts}
    ranked = sorted(ALPHABET, key=lambda c: (-many.get(c, 0), c))
    bit = {c: 1 << (BITS * (k % BANDS) + k // BANDS % BITS) for k, c in enumerate(ranked)}
    return [bit[c] for c in ALPHABET]


def parity_mask(word: Column, bits: list[int]) -> Column:
    """Bits of the letters that occur an odd number of times; other characters have no bit."""
    table = F.array(*(F.lit(b).cast("long") for b in bits))
    code = F.ascii
    place = lambda c: F.when(code(c) < 128, code(c) - 97).otherwise(code(c) - 0xC0 + len(LOWER))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.coalesce(F.get(table, place(c)), F.lit(0).cast("long"))))


def _band(mask: Column, b: int) -> Column:
    return F.shiftright(mask, BITS * b).bitwiseAND(F.lit((1 << BITS) - 1))


def _keys(m: Column) -> Column:
    """Array of (key, b, side) under which a word is filed with others whose shorter one has m letters."""
    half = F.floor(m / 2).cast("int")
    ends = (F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - m + half + 1, m - half))
    return F.array(*(F.struct(F.xxhash64(m, F.lit(b), _band(F.col("mask"), b), F.lit(side), end).alias("key"), F.lit(b).alias("b"), F.lit(side).alias("side")) for b in range(BANDS) for side, end in enumerate(ends)))


def _one_edit(a: Column, b: Column) -> Column:
    """a and b, of equal length or b longer by one, are one edit apart; linear for long words, where levenshtein() isn't."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, F.lit(True)).cast("int")
    rest = F.substring(a, F.when(F.length(a) == F.length(b), at + 1).otherwise(at), F.length(b)) == F.substring(b, at + 1, F.length(b))
    return F.when(F.length(b) > LONG, rest & (at > 0)).otherwise(F.levenshtein(a, b, 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for all pairs of words (word, n) one edit apart, each in both directions.

    words are distinct. Keys are 64-bit hashes and what they stand for is compared again, so a pair
    comes out once: under its first band that agrees, and by its first half if that agrees too.
    A key is a plain join key on both sides: adaptive execution can split one of many words.
    """
    masked = materialize(words.select("word", "n", parity_mask(F.col("word"), letter_bits(words)).alias("mask")), "spelling-masks")
    size = F.length("word")
    # the shorter word of a pair, or the first of equal length; its partners have as many letters or one more
    a = masked.select(F.col("word").alias("wa"), F.col("n").alias("na"), F.col("mask").alias("ma"), F.explode(_keys(size)).alias("k")).select("wa", "na", "ma", "k.*")
    b = masked.select(F.col("word").alias("wb"), F.col("n").alias("nb"), F.col("mask").alias("mb"), F.explode(F.concat(_keys(size), _keys(size - 1))).alias("k")).select("wb", "nb", "mb", F.col("k.key").alias("key_b"))
    flips, m = F.col("ma").bitwiseXOR(F.col("mb")), F.length("wa")
    more = F.length("wb") - m
    low = F.lit((1 << BITS) - 1)
    equal = [F.shiftright(flips, BITS * k).bitwiseAND(low) == 0 for k in range(BANDS)]
    first = F.when(equal[0], 0).when(equal[1], 1).when(equal[2], 2)
    half = F.floor(m / 2).cast("int")
    starts = F.substring("wa", F.lit(1), half) == F.substring("wb", F.lit(1), half)
    fits = (((more == 0) & (F.col("wa") < F.col("wb"))) | (more == 1))
    fits &= (F.bit_count(flips) <= 2) & (first == F.col("b")) & (F.when(starts, 0).otherwise(1) == F.col("side"))
    pairs = a.join(b, F.when(fits, _one_edit(F.col("wa"), F.col("wb"))).otherwise(False) & (F.col("key") == F.col("key_b")))
    both = F.array(F.struct(F.col("wa").alias("word"), F.col("na").alias("n"), F.col("wb").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("wb").alias("word"), F.col("nb").alias("n"), F.col("wa").alias("near"), F.col("na").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: where following them ends; a stored table.

    Each round doubles the length of what has been followed.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step = materialize(now.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.drop("moved")
        now._materialized_path = step._materialized_path


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of distinct words (word, n).

    n_near is the number of words one edit apart. form is the most frequent of these (of equal ones
    the first by code points) if it is at least factor times as frequent as the word, else null, and
    form_n its n. root is where forms lead to from the word, the word itself without a form. Counts grow along forms by factor, at least 2, so
    that there are no circles. An empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its word")
    words = materialize(words.select("word", "n"), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    best = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    known = words.join(best, "word", "left")
    fits = F.col("form_n") >= factor * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    known = materialize(known, "spelling-forms")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
