"""Result files of K requests: one JSON object, and the merging of several."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = ("maxSpatialDistance", "maxTemporalDistance", "temporalUnit", "estimationTime", "simulationTime", "numPartitions")


def space_arrays(curve: DataFrame) -> dict[str, list]:
    """kest, kmin, kmax as lists from threshold 0, which is 0; rows i, l, l_min, l_max."""
    rows = curve.orderBy("i").collect()  # one row per threshold
    pick = lambda c: [0.0] + [r[c] for r in rows]
    return {k: pick(c) for k, c in (("kest", "l"), ("kmin", "l_min"), ("kmax", "l_max")) if c in curve.columns}


def st_arrays(surface: DataFrame) -> dict[str, list]:
    """kest, kmin, kmax as matrices with zero borders; rows i, j, l, l_min, l_max."""
    rows = surface.collect()  # one row per cell
    s, u = max((r["i"] for r in rows), default=0), max((r["j"] for r in rows), default=0)
    out = {}
    for k, c in (("kest", "l"), ("kmin", "l_min"), ("kmax", "l_max")):
        if c in surface.columns:
            m = [[0.0] * (u + 1) for _ in range(s + 1)]
            for r in rows:
                m[r["i"]][r["j"]] = r[c]
            out[k] = m
    return out


def local_rows(curves: DataFrame, band: DataFrame | None = None) -> DataFrame:
    """x, y, k (and kmin, kmax) of local curves (pid, x, y, i, l) and their band: a row per point, arrays from threshold 0, which is 0."""
    if band is not None:
        curves = curves.join(band.select("pid", "i", "l_min", "l_max"), ["pid", "i"], "left")
    names = {"k": "l"} | ({"kmin": "l_min", "kmax": "l_max"} if band is not None else {})
    rows = F.array_sort(F.collect_list(F.struct("i", *names.values())))
    per = curves.groupBy("pid", "x", "y").agg(rows.alias("rows"))
    return per.select("x", "y", *(F.concat(F.array(F.lit(0.0)), F.col(f"rows.{c}")).alias(k) for k, c in names.items()))


def write_json(spark: SparkSession, result: dict, folder: str, size: int, now: datetime | None = None) -> str:
    """Write <folder>/<size>-<yyyy-MM-dd-HH-mm-ss>.json (a folder of one part file); returns its path.

    A table in the result (kest of kind L) is written beside it, a JSON line per row, and named by its path.
    """
    import json

    path = f"{folder.rstrip('/')}/{size}-{(now or datetime.now()).strftime('%Y-%m-%d-%H-%M-%S')}.json"
    tables = {k: v for k, v in result.items() if isinstance(v, DataFrame)}
    for k, v in tables.items():
        v.write.mode("errorifexists").json(f"{path}.{k}")
    result = result | {k: f"{path}.{k}" for k in tables}
    spark.createDataFrame([(json.dumps(result),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return path


def read_matrices(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind, i, j, v) of kest, kmin and kmax in space-time result files."""
    schema = ", ".join(f"{k} array<array<double>>" for k in ("kest", "kmin", "kmax"))
    doc = spark.read.schema(schema).json(paths).withColumn("path", F.input_file_name())
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("m")) for k in ("kest", "kmin", "kmax"))))
    rows = doc.select("path", kinds.alias("q")).select("path", "q.kind", F.posexplode("q.m").alias("i", "line"))
    return rows.select("path", "kind", "i", F.posexplode("line").alias("j", "v"))


def merge(cells: DataFrame, order: str = "path") -> DataFrame:
    """i, j, kest, kmin, kmax of several results: the last kest by order, the extremes of the others.

    Any grid size; the border row and column stay.
    """
    of = lambda kind: F.when(F.col("kind") == kind, F.col("v"))
    last = F.max_by(of("kest"), F.when(F.col("kind") == "kest", F.col(order)))
    return cells.groupBy("i", "j").agg(last.alias("kest"), F.min(of("kmin")).alias("kmin"), F.max(of("kmax")).alias("kmax"))


def pivot_text(cells: DataFrame, value: str = "l", columns: int | None = None) -> DataFrame:
    """A line of comma-separated values per i, for printing."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(value).alias("v")))), lambda c: F.coalesce(c["v"].cast("string"), F.lit(""))), ",")
    return cells.groupBy("i").agg(line.alias("line")).orderBy("i")
