"""Facade: a K request as a dictionary in, a result dictionary out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import kfunction, simulate
from ..operators.kfunction import Scale
from ..sources import results
from ..sources.boundary import Region, envelope_region

KINDS = ("S", "ST", "Cross", "L")
#: How patterns are simulated: drawn from the data (ST: times dealt anew), or at random in the region.
SIMULATIONS = ("data", "random")
CORRECTIONS = ("isotropic", "translation", "border", "none")


def run_kfunction(spark: SparkSession, request: dict, datasets: dict[str, DataFrame], region: Region | None = None) -> dict:
    """Compute a request of maxSpatialDistance, maxTemporalDistance, spatialStep, temporalStep,
    simulationTimes, ktype (S, ST, Cross, L), dataName, dataName2, temporalUnit,
    simulationType (data, which is the default, or random; local K knows data only) and
    edgeCorrection (isotropic, which is the default and the only one of simulations, translation,
    none, and of S and ST border).

    kest, kmin and kmax are lists (ST: matrices); for L kest is a table of x, y, k, kmin and kmax,
    a row per point, which results.write_json() writes without collecting it. kmin and kmax are
    there if simulations are asked for.

    Datasets are point tables by name; the region is the data's own, widened, if none is
    given. Unknown kinds and names, and Cross of a dataset with itself, are errors.
    """
    kind = request.get("ktype")
    if kind not in KINDS:
        raise ValueError(f"ktype must be one of {', '.join(KINDS)}")
    r, sims = float(request["maxSpatialDistance"]), int(request.get("simulationTimes", 0))
    if not 1 <= r <= 100_000 or not 0 <= sims <= 1000:
        raise ValueError("maxSpatialDistance goes from 1 to 100000, simulationTimes to 1000")
    how = request.get("simulationType", "data")
    if how not in SIMULATIONS or (how == "random" and kind == "L"):
        raise ValueError("simulationType must be data or, but for local K, random")
    correction = request.get("edgeCorrection", "isotropic")
    if correction not in CORRECTIONS or (correction == "border" and kind not in ("S", "ST")):
        raise ValueError("edgeCorrection must be isotropic, translation, none or, of S and ST, border")
    if sims and correction != "isotropic":
        raise ValueError("simulations have the isotropic correction only")
    unit = request.get("temporalUnit", "DAYS")
    t = int(request.get("maxTemporalDistance", 0)) if kind == "ST" else 0
    scale = Scale(r, int(request["spatialStep"]), t, int(request.get("temporalStep", 1)) if kind == "ST" else 1, unit)
    try:
        points = datasets[request["dataName"]]
        other = datasets[request["dataName2"]] if kind == "Cross" else None
    except KeyError as missing:
        raise ValueError(f"no such dataset: {missing}") from None
    if kind == "Cross" and request["dataName"] == request["dataName2"]:
        raise ValueError("Cross needs two different datasets")
    region = region or envelope_region(points)
    out = {"KType": kind, "edgeCorrection": correction, "maxSpatialDistance": r, "maxTemporalDistance": t, "temporalUnit": unit}
    began = time.time()
    if kind == "S":
        curve = kfunction.border_space(points, region, scale) if correction == "border" else kfunction.space_k(points, region, scale, correction=correction)
        out |= results.space_arrays(curve)
    elif kind == "ST":
        surface = kfunction.border_st(points, region, scale) if correction == "border" else kfunction.st_k(points, region, scale, correction=correction)
        out |= results.st_arrays(surface)
    elif kind == "Cross":
        out |= results.space_arrays(kfunction.cross_k(points, other, region, scale, correction))
    else:
        out["kest"] = results.local_rows(kfunction.local_k(points, region, scale, correction=correction), simulate.local_envelope(points, region, scale, sims) if sims else None)
    out["estimationTime"] = int((time.time() - began) * 1000)
    if sims and kind != "L":
        began = time.time()
        if how == "random":
            n = points.count()
            if kind == "Cross":
                band = simulate.csr_cross_envelope(spark, region, n, other.count(), scale, sims)
            else:
                band = (simulate.csr_envelope if kind == "S" else simulate.csr_st_envelope)(spark, region, n, scale, sims)
        elif kind == "Cross":
            band = simulate.cross_envelope(points, other, region, scale, sims)
        else:
            band = (simulate.space_envelope if kind == "S" else simulate.st_envelope)(points, region, scale, sims)
        arrays = results.st_arrays if kind == "ST" else results.space_arrays
        out |= {k: v for k, v in arrays(band).items() if k != "kest"}
        out["simulationTime"] = int((time.time() - began) * 1000) // sims
    out["numPartitions"] = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out
