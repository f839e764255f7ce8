"""Reading facts: one table, many files, many years."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.errors import ResourceRuntimeError
from aeolith.functions.scaling import clean, unscale

from .catalog import GENERIC, Catalog, ResourceSpec

_YEAR = re.compile(r".*[^0-9]([1-2][0-9]{3})($|[^0-9])")
_FRACTIONS = ("float", "double")


def path_kind(path: str | Sequence[str]) -> str:
    """local, store (any other scheme than file), and with a wildcard or a list: many."""
    first = path if isinstance(path, str) else path[0]
    scheme = first.split("://", 1)[0] if "://" in first else "file"
    where = "local" if scheme == "file" else "store"
    return f"{where}-many" if not isinstance(path, str) or "*" in first else where


def is_object_store(path: str) -> bool:
    return path.split("://", 1)[0] in ("s3", "s3a", "s3n", "gs", "abfss")


def wave_domain(root: str, domain: str, buoys: bool = False) -> str:
    """The pattern of the yearly files of a domain below a root, or of its virtual buoys."""
    return f"{root.rstrip('/')}/{'virtual_buoy/' if buoys else ''}{domain}/*"


def require_writable(path: str, mode: str) -> None:
    """Object stores reached for reading only are never opened for writing."""
    if is_object_store(path) and mode not in ("r", "read"):
        raise OSError(f"{path} can only be read")


def year_of(name: str, required: bool = True) -> int | None:
    """The last four digits from 1000 to 2999 that stand alone in a file name."""
    found = _YEAR.match(name)
    if not found and required:
        raise ResourceRuntimeError(f"{name} names no year")
    return int(found[1]) if found else None


def year_from_file(column: Column | None = None) -> Column:
    """The same from a column of paths, by default that of each row."""
    path = F.input_file_name() if column is None else column
    return F.nullif(F.regexp_extract(path, r".*[^0-9]([1-2][0-9]{3})($|[^0-9])", 1), F.lit("")).cast("int")


def normalised(facts: DataFrame, spec: ResourceSpec = GENERIC, attributes: dict[str, dict[str, object]] | None = None) -> DataFrame:
    """Stored values as physical ones, NaN as null; names and attributes stay."""
    catalog = Catalog.of(facts, spec, attributes)
    kinds = dict(facts.dtypes)
    out = []
    for c in facts.columns:
        a = catalog.attributes.get(c, {})
        value = F.col(f"`{c}`")
        if c in catalog.datasets:
            if kinds[c] in _FRACTIONS:
                value = clean(value)
            value = unscale(value, spec.scale(a), spec.adder(a))
        out.append(value.alias(c, metadata=a) if a else value.alias(c))
    return facts.select(*out)


def read_facts(spark: SparkSession, path: str | Sequence[str], spec: ResourceSpec = GENERIC, group: str | None = None, raw: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """Facts of one or several Parquet paths, as physical values unless ``raw``; columns of a group lose its prefix."""
    paths = [path] if isinstance(path, str) else list(path)
    facts = spark.read.parquet(*paths)
    if group:
        prefix = group.rstrip("/") + "/"
        names = [c for c in facts.columns if c in ("gid", "ts") or c.startswith(prefix)]
        facts = facts.select(*[F.col(f"`{c}`").alias(c.removeprefix(prefix)) for c in names])
    facts = facts.drop(*drop)
    return facts if raw else normalised(facts, spec)


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The paths a pattern matches, by the file system it lives in; a folder without wildcard is an error."""
    if "*" not in pattern:
        raise ResourceRuntimeError(f"{pattern} has no wildcard")
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(pattern)
    return sorted(str(f.getPath()) for f in found)


def by_dataset(parts: Sequence[DataFrame], check: bool = False) -> DataFrame:
    """Files with different datasets of the same sites and times as one table.

    A dataset in several files comes from the last; with ``check``, files whose
    sites and times differ are an error.
    """
    keys = ["gid", "ts"]
    if check:
        for other in parts[1:]:
            odd = parts[0].select(*keys).join(other.select(*keys).withColumn("there", F.lit(1)), keys, "full").where("there IS NULL").limit(1).count()
            more = other.select(*keys).join(parts[0].select(*keys), keys, "left_anti").limit(1).count()
            if odd or more:
                raise ResourceRuntimeError("files differ in their sites or times")
    out = parts[0]
    for other in parts[1:]:
        again = [c for c in other.columns if c in out.columns and c not in keys]
        out = out.drop(*again).join(other, keys)
    return out


def by_time(parts: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """Files of different times as one table, with all their datasets; a time in two files is an error."""
    if check:
        times = [p.select("ts").distinct() for p in parts]
        if reduce(DataFrame.unionByName, times).groupBy("ts").count().where("count > 1").limit(1).count():
            raise ResourceRuntimeError("times repeat between files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_year(spark: SparkSession, paths: Sequence[str], years: Sequence[int] | None = None, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Files named by year; several of one year hold its datasets.  A year asked for but absent is an error."""
    read = read or read_facts
    found: dict[int, list[str]] = {}
    for p in paths:
        found.setdefault(year_of(PurePosixPath(p).name), []).append(p)
    wanted = sorted(found) if years is None else list(years)
    absent = [y for y in wanted if y not in found]
    if absent:
        raise ResourceRuntimeError(f"no files for {absent}")
    return by_time([by_dataset([read(spark, p) for p in sorted(found[y])]).withColumn("year", F.lit(y)) for y in wanted], check=False)


def in_years(facts: DataFrame, years: Sequence[int | str]) -> DataFrame:
    """Rows of those years, by ranges of ts that reach the Parquet scan."""
    spans = [in_year(int(y)) for y in years]
    return facts.where(reduce(lambda a, b: a | b, spans, F.lit(False)))


def in_year(year: int, ts: str = "ts") -> Column:
    at = F.col(ts)
    return (at >= F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")) & (at < F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz"))


def combined_times(parts: Sequence[DataFrame]) -> DataFrame:
    """Union along time of the datasets that all parts have; their types must agree."""
    return reduce(DataFrame.unionByName, _common(parts))


def combined_sites(parts: Sequence[DataFrame]) -> DataFrame:
    """Union along sites: gids of each part follow those of the parts before."""
    out, offset = [], F.lit(0).cast("long")
    for part in _common(parts):
        out.append(part.withColumn("gid", F.col("gid") + offset))
        size = part.agg((F.coalesce(F.max("gid"), F.lit(-1)) + 1).alias("n"))
        offset = offset + size.scalar()
    return reduce(DataFrame.unionByName, out)


def _common(parts: Sequence[DataFrame]) -> list[DataFrame]:
    names = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    kinds = {tuple(dict(p.dtypes)[c] for c in names) for p in parts}
    if len(kinds) > 1:
        raise ResourceRuntimeError(f"types of {names} differ between files")
    return [p.select(*names) for p in parts]


def read_table(spark: SparkSession, source: str | dict | DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """A small table from csv, json, a dict of columns or a frame; an unnamed index column goes."""
    if isinstance(source, DataFrame):
        out = source
    elif isinstance(source, dict):
        out = spark.createDataFrame(list(zip(*source.values(), strict=True)), list(source))
    elif source.endswith(".csv"):
        out = spark.read.csv(source, header=True, inferSchema=True)
    elif source.endswith(".json"):
        out = spark.read.json(source, multiLine=True)
    else:
        raise ValueError(f"{source} is neither csv nor json")
    out = out.drop(*[c for c in out.columns if c in ("Unnamed: 0", "_c0")])
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return out


def site_list(spark: SparkSession, source: str | dict | DataFrame) -> DataFrame:
    """Sites by ``gid``, or by latitude and longitude."""
    out = read_table(spark, source)
    if "gid" not in out.columns and not {"latitude", "longitude"} <= set(out.columns):
        raise ValueError("a site list needs gid, or latitude and longitude")
    return out


def retried(tries: int = 3, seconds: float = 1.0):
    """Calls a driver-side function again after an error; tasks have retries of their own."""
    import functools
    import time

    def wrap(f):
        @functools.wraps(f)
        def call(*a, **k):
            for left in range(tries - 1, -1, -1):
                try:
                    return f(*a, **k)
                except Exception:
                    if not left:
                        raise
                    time.sleep(seconds)

        return call

    return wrap
