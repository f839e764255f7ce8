"""Writers: tables, statistics, subsets and site-model files."""

from __future__ import annotations

import itertools
import json
import uuid
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.errors import ResourceRuntimeError, ResourceWarning
from aeolith.functions.scaling import smallest_integer, to_stored

from .catalog import INDEX


def shrink_meta(meta: DataFrame) -> DataFrame:
    """Metadata types as stored: floats single, integers the smaller type that holds all, text as text."""
    kinds = dict(meta.dtypes)
    whole = [c for c, k in kinds.items() if k in ("int", "bigint", "smallint", "tinyint")]
    bounds = meta.agg(*[f(c).alias(f"{n}_{c}") for c in whole for n, f in (("lo", F.min), ("hi", F.max))]).first() if whole else None
    out = []
    for c, k in kinds.items():
        if c in whole and bounds[f"lo_{c}"] is not None:
            out.append(F.col(c).cast(smallest_integer(bounds[f"lo_{c}"], bounds[f"hi_{c}"])))
        else:
            out.append(F.col(c).cast("float") if k == "double" else F.col(c))
    return meta.select(*[x.alias(c) for x, c in zip(out, kinds, strict=True)])


def scaled(facts: DataFrame, attributes: dict[str, dict]) -> DataFrame:
    """Datasets in their stored types: half-even rounding of value * scale_factor, attributes in the schema."""
    kinds = dict(facts.dtypes)
    out = []
    for c in facts.columns:
        a = attributes.get(c)
        if a and "dtype" in a:
            value = to_stored(F.col(c), a["dtype"], a.get("scale_factor", 1), kinds[c] in ("float", "double"))
            out.append(value.alias(c, metadata={k: v for k, v in a.items() if k != "dtype"}))
        else:
            out.append(F.col(c))
    return facts.select(*out)


def check_shape(facts: DataFrame, meta: DataFrame, times: DataFrame) -> None:
    """Every site at every time, once."""
    want = meta.count() * times.count()
    have, distinct = facts.agg(F.count("*"), F.count_distinct("gid", "ts")).first()
    if have != want or distinct != want:
        raise ValueError(f"{have} rows for {want} places of sites and times")


def write_profiles(
    facts: DataFrame, path: str, attributes: dict[str, dict] | None = None, meta: DataFrame | None = None, configs: dict | None = None, mode: str = "errorifexists", by_year: bool = False, times: DataFrame | None = None
) -> None:
    """facts, sorted by site and time inside files, with metadata and configs beside them.

    With ``meta`` and ``times`` every site must be there at every time, once; nothing is
    written otherwise.
    """
    if meta is not None and times is not None:
        check_shape(facts, meta, times)
    out = scaled(facts, attributes or {})
    if by_year:
        out = out.withColumn("year", F.year("ts"))
    out = out.repartitionByRange(F.col("gid")).sortWithinPartitions("gid", "ts")
    writer = out.write.mode(mode)
    (writer.partitionBy("year") if by_year else writer).parquet(f"{path}/facts")
    if meta is not None:
        shrink_meta(meta).write.mode(mode).parquet(f"{path}/meta")
    if configs:
        rows = [(k, json.dumps(v)) for k, v in configs.items()]
        facts.sparkSession.createDataFrame(rows, "name string, config string").write.mode(mode).parquet(f"{path}/configs")


def create_store(path: str, meta: DataFrame, times: DataFrame, configs: dict | None = None, mode: str = "errorifexists") -> None:
    """A store without datasets: its sites, its times, and how it was made."""
    shrink_meta(meta).write.mode(mode).parquet(f"{path}/meta")
    times.select("ts").distinct().write.mode(mode).parquet(f"{path}/time_index")
    if configs:
        rows = [(k, json.dumps(v)) for k, v in configs.items()]
        meta.sparkSession.createDataFrame(rows, "name string, config string").write.mode(mode).parquet(f"{path}/configs")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, path: str) -> list[int]:
    fs, where = _folder(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, commit: int | None = None) -> dict[str, dict]:
    """name: {"version": folder or null, "type": ..., "attributes": ...} of a store, as the last commit or an earlier one has it."""
    known = _commits(spark, path)
    if commit is not None and commit not in known:
        raise FileNotFoundError(f"{path} has no commit {commit}")
    if not known:
        return {}
    text = spark.read.text(f"{path}/commits/{known[-1] if commit is None else commit:08d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, changes: dict[str, dict], seen: int) -> int:
    """Names the state that follows commit ``seen``; another writer's commit since then is an error.

    The manifest is written beside its place and renamed into it, which either happens or
    does not: readers see the state before or after.
    """
    fs, folder = _folder(spark, f"{path}/commits")
    fs.mkdirs(folder)
    known = manifest(spark, path, seen) if seen else {}
    _, place = _folder(spark, f"{path}/commits/{seen + 1:08d}.json")
    _, fresh = _folder(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(json.dumps({**known, **changes}, sort_keys=True).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(fresh, place):
        fs.delete(fresh, False)
        raise ResourceRuntimeError(f"{path} was changed since commit {seen}")
    return seen + 1


def _last(spark: SparkSession, path: str) -> int:
    return max(_commits(spark, path), default=0)


def _put(path: str, stored: DataFrame, name: str, seen: int) -> int:
    """Writes a version of a dataset whole, then commits it; one without every site at every time, once, is deleted again and an error.

    Rows are counted as they are written.  They come sorted by site and time, so that a
    repeated one follows its like, and no other pass or shuffle is needed to find it.
    """
    spark, version = stored.sparkSession, f"v{uuid.uuid4().hex}"
    want = spark.read.parquet(f"{path}/meta").count() * spark.read.parquet(f"{path}/time_index").count()
    before = F.lag("ts").over(Window.partitionBy("gid").orderBy("ts"))
    rows = stored.repartitionByRange("gid").withColumn("__before", before).sortWithinPartitions("gid", "ts")
    told = Observation()
    wrong = F.col("gid").isNull() | F.col("ts").isNull() | (F.coalesce(F.col("__before") == F.col("ts"), F.lit(False)))
    rows.observe(told, F.count("*").alias("have"), F.count_if(wrong).alias("wrong")).drop("__before").write.parquet(f"{path}/datasets/{name}/{version}")
    have, repeated = told.get["have"], told.get["wrong"]
    if have != want or repeated:
        fs, folder = _folder(spark, f"{path}/datasets/{name}/{version}")
        fs.delete(folder, True)
        if not fs.listStatus(folder.getParent()):
            fs.delete(folder.getParent(), False)
        raise ValueError(f"{have} rows, {repeated} of them repeated or without place, for {want} places of sites and times")
    field = stored.schema[name]
    return _commit(spark, path, {name: {"version": version, "type": field.dataType.simpleString(), "attributes": field.metadata}}, seen)


def declare_dataset(path: str, spark: SparkSession, name: str, dtype: str, attributes: dict | None = None) -> int:
    """A dataset without values yet: its type and attributes are fixed, reads give null for every site and time."""
    seen = _last(spark, path)
    if name in manifest(spark, path):
        raise ValueError(f"{name} is there already")
    return _commit(spark, path, {name: {"version": None, "type": dtype, "attributes": attributes or {}}}, seen)


def write_dataset(path: str, values: DataFrame, name: str, attributes: dict | None = None, mode: str = "errorifexists") -> int:
    """A dataset of a store, in folders of its own: no other is written again.  Returns the number of the commit.

    ``values`` (gid, ts, name) must hold every site at every time, once.  A declared
    dataset takes its type and attributes from its declaration.
    """
    spark = values.sparkSession
    seen = _last(spark, path)
    known = manifest(spark, path).get(name)
    if known and known["version"] and mode == "errorifexists":
        raise ValueError(f"{name} is there already")
    if known and not known["version"] and attributes is None:
        attributes = {"dtype": known["type"], **known["attributes"]}
    return _put(path, scaled(values.select("gid", "ts", name), {name: attributes} if attributes else {}), name, seen)


def update_dataset(path: str, values: DataFrame, name: str, attributes: dict | None = None) -> bool:
    """Writes a dataset again if that changes anything as stored; True if so.

    The new version is whole before a commit names it, and the old one stays until
    vacuum(): a reader finds one or the other, so ``values`` may be made from the old one.
    """
    spark = values.sparkSession
    seen = _last(spark, path)
    old = read_store(spark, path, [name])
    attributes = attributes or {"dtype": dict(old.dtypes)[name], **old.schema[name].metadata}
    new = scaled(values.select("gid", "ts", name), {name: attributes})
    # most updates change the first site met, which spares the comparison of all
    some = old.select("gid").first()
    if not (some and differs(*(x.where(F.col("gid") == some.gid) for x in (old, new)), name)) and not differs(old, new, name):
        return False
    _put(path, new, name, seen)
    return True


def read_store(spark: SparkSession, path: str, names: Sequence[str], commit: int | None = None) -> DataFrame:
    """Datasets of a store side by side, as stored, in the state of the last commit or an earlier one; several are joined by site and time."""
    known = manifest(spark, path, commit)
    absent = [n for n in names if n not in known]
    if absent:
        raise ResourceRuntimeError(f"{path} has no {absent}")
    parts = [spark.read.parquet(f"{path}/datasets/{n}/{known[n]['version']}") for n in names if known[n]["version"]]
    if not parts:
        parts = [spark.read.parquet(f"{path}/meta").select(F.col("gid").cast("long")).crossJoin(spark.read.parquet(f"{path}/time_index"))]
    out = reduce(lambda a, b: a.join(b, ["gid", "ts"]), parts)
    return out.withColumns({n: F.lit(None).cast(known[n]["type"]).alias(n, metadata=known[n]["attributes"]) for n in names if not known[n]["version"]}).select("gid", "ts", *names)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes versions that the last commit does not name, and earlier commits; for when no reader uses them."""
    fs, top = _folder(spark, f"{path}/datasets")
    known, last, gone = manifest(spark, path), _last(spark, path), []
    for folder in fs.listStatus(top) if fs.exists(top) else []:
        name = folder.getPath().getName()
        for version in fs.listStatus(folder.getPath()):
            if version.getPath().getName() != known.get(name, {}).get("version"):
                fs.delete(version.getPath(), True)
                gone.append(f"{name}/{version.getPath().getName()}")
    for n in _commits(spark, path):
        if n < last:
            fs.delete(_folder(spark, f"{path}/commits/{n:08d}.json")[1], False)
    return sorted(gone)


def write_means(means: DataFrame, path: str, sites: int, mode: str = "errorifexists") -> None:
    if means.count() != sites:
        raise ValueError("one value a site is needed")
    means.write.mode(mode).parquet(path)


def add_dataset(facts: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """A dataset joined to facts by site and time, by site, or by time."""
    keys = [k for k in ("gid", "ts") if k in values.columns]
    return facts.drop(name).join(values.select(*keys, name), keys, "left")


def differs(stored: DataFrame, values: DataFrame, name: str) -> bool:
    """Whether an update changes anything."""
    both = stored.select("gid", "ts", F.col(name).alias("old")).join(values.select("gid", "ts", F.col(name).alias("new")), ["gid", "ts"], "full")
    return bool(both.where("NOT old <=> new").limit(1).count())


def subset(facts: DataFrame, sites: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Raw values of some sites; attributes stay in the schema.  Datasets that are not there are passed over with a warning."""
    absent = [n for n in datasets or () if n not in facts.columns]
    if absent:
        warnings.warn(f"no datasets {absent}: they are passed over", ResourceWarning, stacklevel=2)
    keep = [c for c in facts.columns if datasets is None or c in INDEX or c in datasets]
    return facts.join(sites.select("gid"), "gid", "left_semi").select(*keep)


def write_statistics(stats: DataFrame, path: str, name: str = "stats") -> str:
    """One csv or json file by the suffix; into a folder goes ``<name>.csv`` (without *).

    Rows are sorted by range in many tasks; the driver passes them on to the file one
    partition at a time.
    """
    if not path.endswith((".csv", ".json")):
        path = f"{path.rstrip('/')}/{name.replace('*', '')}.csv"
    flat = stats.select(*[F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in stats.dtypes])
    if path.endswith(".csv"):
        quoted = [F.when(F.col(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in flat.columns]
        lines, head = flat.orderBy(flat.columns[0]).select(F.concat_ws(",", *quoted).alias("line")), ",".join(flat.columns) + "\n"
    else:
        lines, head = flat.orderBy(flat.columns[0]).select(F.to_json(F.struct(*flat.columns)).alias("line")), ""
    fs, place = _folder(stats.sparkSession, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(head.encode()))
        for some in itertools.batched(lines.toLocalIterator(), 10_000):
            out.write(bytearray("".join(row.line + "\n" for row in some).encode()))
    finally:
        out.close()
    return path


def write_joint_density(density: DataFrame, meta: DataFrame, path: str) -> None:
    density.write.mode("overwrite").option("header", True).csv(path)
    meta.write.mode("overwrite").option("header", True).csv(path.removesuffix(".csv") + "_meta.csv")


def header(meta: dict, wind: bool = False) -> list[str]:
    """The head of a site file: two lines of names and values, or one of both for wind."""
    names = {"timezone": "Time Zone", "gid": "Location ID"}
    pairs = [(names.get(k, k.capitalize()), str(v).replace(",", "")) for k, v in meta.items()]
    if wind:
        return [",".join(x for p in pairs for x in p)]
    return [",".join(k for k, _ in pairs), ",".join(v for _, v in pairs)]


def write_site_files(tables: DataFrame, meta: DataFrame, folder: str, wind: bool = False, heads: Sequence[Sequence[str]] = ()) -> DataFrame:
    """One csv a site, written by the tasks; returns (gid, file).  A site's rows fit in memory: one site, all times.

    ``heads`` are rows between the names of the columns and their values.
    """
    columns = [c for c in tables.columns if c not in ("gid", "ts")]
    joined = tables.join(meta.select("gid", F.struct(*meta.columns).alias("__meta")), "gid")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        gid, info = table["gid"][0].as_py(), table["__meta"][0].as_py()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        rows = zip(*[table[c].to_pylist() for c in columns], strict=True)
        text = "\n".join([*header(info, wind), ",".join(columns), *[",".join(h) for h in heads], *[",".join("" if x is None else str(x) for x in r) for r in rows]]) + "\n"
        with fs.open_output_stream(f"{root}/{gid}.csv", compression=None) as out:
            out.write(text.encode())
        return pa.table({"gid": pa.array([gid], pa.int64()), "file": pa.array([f"{gid}.csv"], pa.string())})

    return joined.withColumn("gid", F.col("gid").cast("long")).groupBy("gid").applyInArrow(write, "gid long, file string")


def write_json(value: object, path: str) -> None:
    fs, target = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_output_stream(target) as out:
        out.write(json.dumps(value, indent=4, sort_keys=True, default=str).encode())


def batches(gids: Sequence[int], n: int = 36) -> Iterator[list[int]]:
    """gids in n runs of nearly one size."""
    n = max(1, min(n, len(gids)))
    size, more = divmod(len(gids), n)
    at = 0
    for i in range(n):
        end = at + size + (i < more)
        yield list(gids[at:end])
        at = end
