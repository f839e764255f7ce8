"""Storage layout: chunk sizes, columns by height, rewriting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.functions.scaling import converted
from aeolith.operators.ordered import thinned

from .catalog import INDEX, Catalog, ResourceSpec, parse_name

#: Variables at the surface, kept with height 0.
SURFACE = ("pressure", "temperature", "relativehumidity", "inversemoninobukhovlength", "precipitationrate")
_BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8}


def timeseries_chunk(times: int, sites: int, dtype: str = "float", megabytes: float = 2, weeks: int | None = None) -> tuple[int, int]:
    """(times, sites) of a storage chunk that holds some weeks of a year of data."""
    step = times / 8760
    weeks = math.ceil(8 / step) if weeks is None else weeks
    t = math.ceil(weeks * 7 * 24 * step)
    if t >= times:
        t = math.ceil(times / 4)
    return t, min(sites, math.ceil(megabytes / (t * _BYTES[dtype] * 1e-6)))


def array_chunk(shape: tuple[int, ...], dtype: str = "float", megabytes: float = 2) -> tuple[int, ...] | None:
    """None for arrays of less than 2 MB, otherwise chunks along the first axis."""
    size = math.prod(shape) * _BYTES[dtype] * 1e-6
    return None if size < 2 else (max(1, math.ceil(shape[0] * megabytes / size)), *shape[1:])


def at_height(facts: DataFrame, height: float, spec: ResourceSpec) -> DataFrame:
    """Datasets at one height; with 0 also those of the surface."""
    keep = []
    for c in facts.columns:
        variable, h = parse_name(c, spec.unit)
        if c in INDEX or h == height or (height == 0 and (variable in SURFACE or (h is not None and variable.startswith(SURFACE) and h <= 2))):
            keep.append(c)
    return facts.select(*keep)


def relaid(facts: DataFrame, path: str, dtypes: dict[str, tuple[str, float | None]] | None = None, height: float | None = None, spec: ResourceSpec | None = None, resolution_seconds: int | None = None, files: int | None = None, mode: str = "errorifexists") -> DataFrame:
    """Facts rewritten for reads by site: ranges of gids, sorted by time; optionally thinned, at one height, in other types."""
    out = facts if height is None else at_height(facts, height, spec)
    if resolution_seconds:
        out = thinned(out, resolution_seconds)
    kinds = dict(out.dtypes)
    out = out.withColumns({c: converted(F.col(c), kinds[c], t, s) for c, (t, s) in (dtypes or {}).items() if c in kinds})
    dealt = out.repartitionByRange(files, "gid") if files else out.repartitionByRange("gid")
    dealt.sortWithinPartitions("gid", "ts").write.mode(mode).parquet(path)
    return facts.sparkSession.read.parquet(path)


#: Bits of each side of the curve over sites and times.
_CURVE_BITS = 12


def clustered(facts: DataFrame, path: str, files: int, megabytes: float = 8, mode: str = "errorifexists") -> DataFrame:
    """Facts rewritten for reads by site and period: each row group holds a box of near gids and near times.

    Both are scaled to their range and interleaved bit by bit; files are ranges of that
    curve, of about equal size, and are sorted along it.  The least and largest gid and
    ``day`` of a row group stand in its footer, so a scan skips the groups that a filter
    on both rules out.  The day is a column of its own, as Spark does not hold times
    without zone against footers; ``during`` filters by both.
    """
    lo_g, hi_g, lo_t, hi_t = facts.agg(F.min("gid"), F.max("gid"), F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    most = (1 << _CURVE_BITS) - 1
    sides = [
        F.floor((x - F.lit(lo)) * F.lit(most) / F.lit(max(hi - lo, 1))).cast("long")
        for x, lo, hi in ((F.col("gid"), lo_g or 0, hi_g or 0), (F.unix_seconds(F.col("ts").cast("timestamp")), lo_t or 0, hi_t or 0))
    ]
    code = F.lit(0).cast("long")
    for bit in range(_CURVE_BITS):
        for i, side in enumerate(sides):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(side, bit).bitwiseAND(1), 2 * bit + i))
    out = facts.withColumn("day", F.to_date("ts")).withColumn("__code", F.coalesce(code, F.lit(0))).repartitionByRange(files, "__code").sortWithinPartitions("__code", "gid", "ts").drop("__code")
    out.write.mode(mode).option("parquet.block.size", int(megabytes * (1 << 20))).parquet(path)
    return facts.sparkSession.read.parquet(path)


def during(start: str, end: str) -> Column:
    """Times from start up to but without end, of clustered files."""
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return F.col("day").between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")) & (F.col("ts") >= first) & (F.col("ts") < last)


def rows_scanned(df: DataFrame) -> int:
    """How many rows the scans of a plan without shuffles hand on when it runs: those of the row groups that its filters do not rule out."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def describe_layout(facts: DataFrame, spec: ResourceSpec) -> DataFrame:
    """Datasets with types and the chunk they would get."""
    n = facts.agg(F.count_distinct("ts"), F.count_distinct("gid")).first()
    kinds = dict(facts.dtypes)
    rows = [(d, kinds[d], *timeseries_chunk(max(n[0], 1), max(n[1], 1), kinds[d] if kinds[d] in _BYTES else "float")) for d in Catalog.of(facts, spec).datasets]
    return facts.sparkSession.createDataFrame(rows, "dataset string, dtype string, chunk_times long, chunk_sites long")
