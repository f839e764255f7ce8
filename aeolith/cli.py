"""Command line: statistics, densities, extraction and storage layout of Parquet facts.

A resource is a folder with ``facts`` and ``meta`` tables, or a path or pattern of
facts with ``--meta``.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.operators import jointpd, select, spatial, stats
from aeolith.operators.derive import with_dataset
from aeolith.plans import site_model
from aeolith.session import session
from aeolith.sources import layout, scan, sink
from aeolith.sources.catalog import PRESETS


def _pair(text: str) -> tuple[float, float]:
    a, b = (float(x) for x in text.strip("()[]").split(","))
    return a, b


def _integers(text: str) -> list[int]:
    """``[1, 2, 5]``, ``1,2,5`` or ``0:10:2``."""
    if ":" in text:
        return list(range(*(int(x) for x in text.split(":"))))
    return [int(x) for x in text.strip("[]()").replace(" ", "").split(",")]


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.strip("[]").split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aeolith", description=__doc__.split("\n")[0])
    p.add_argument("resource", help="folder, path or pattern of facts")
    p.add_argument("--meta", help="path of the sites")
    p.add_argument("--kind", default="generic", choices=sorted(PRESETS))
    p.add_argument("--years", type=_integers, help="only these years")
    p.add_argument("--domain", choices=["West_Coast", "Hawaii"], help="RESOURCE is the root of wave data; read the yearly files of this domain")
    p.add_argument("--buoy", action="store_true", help="the virtual buoys of the domain")
    p.add_argument("--out", required=True, help="where the result goes")
    p.add_argument("--master", help="Spark master")
    sub = p.add_subparsers(dest="command", required=True)

    s = sub.add_parser("stats", help="statistics over time")
    s.add_argument("--dataset", required=True)
    s.add_argument("--statistics", type=_names, default=["mean", "median", "std"])
    s.add_argument("--period", default="all", choices=["all", "full", "monthly", "diurnal", "monthly_diurnal"])
    s.add_argument("--mask-zeros", action="store_true")
    s.add_argument("--wide", action="store_true")

    s = sub.add_parser("means", help="mean of each site with its coordinates")
    s.add_argument("--dataset", required=True)
    s.add_argument("--year", type=int)

    s = sub.add_parser("wind-rose", help="joint density of wind speed and direction")
    s.add_argument("--height", type=float, required=True)
    s.add_argument("--speed-bins", type=lambda t: tuple(float(x) for x in t.split(",")), default=(0, 30, 1))
    s.add_argument("--direction-bins", type=lambda t: tuple(float(x) for x in t.split(",")), default=(0, 360, 5))

    for name, text in (("site", "one site"), ("region", "sites of a region"), ("box", "sites in a box"), ("sites", "sites of a list")):
        s = sub.add_parser(name, help=f"a dataset at {text}")
        s.add_argument("--dataset", required=True)
        s.add_argument("--timestep", help="one time as a map")
        if name == "site":
            s.add_argument("--gid", type=int)
            s.add_argument("--lat-lon", type=_pair)
        elif name == "region":
            s.add_argument("--region", required=True)
            s.add_argument("--column", default="state")
        elif name == "box":
            s.add_argument("--corners", type=_pair, nargs=2, required=True)
        else:
            s.add_argument("--sites", required=True, help="csv or json with gid, or latitude and longitude")

    s = sub.add_parser("site-model", help="input tables of a site model, one csv a site")
    s.add_argument("--technology", required=True)
    s.add_argument("--height", type=float)
    s.add_argument("--gids", type=_integers)
    s.add_argument("--lat-lon", type=_pair)

    s = sub.add_parser("rechunk", help="rewrite facts for reads by site")
    s.add_argument("--height", type=float)
    s.add_argument("--resolution-seconds", type=int)
    s.add_argument("--dtypes", type=json.loads, default={}, help='{"dataset": ["smallint", 100]}')

    s = sub.add_parser("combine", help="several facts along time or sites")
    s.add_argument("--others", nargs="+", required=True)
    s.add_argument("--axis", choices=["time", "sites"], default="time")
    return p


def _load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame | None]:
    spec = PRESETS[a.kind]
    if a.buoy and not a.domain:
        raise SystemExit("--buoy needs --domain")
    resource = scan.wave_domain(a.resource, a.domain, a.buoy) if a.domain else a.resource
    paths = scan.expand(spark, resource) if "*" in resource else [resource]
    if a.years and all(scan.year_of(PurePosixPath(p).name, required=False) for p in paths):
        facts = scan.by_year(spark, paths, a.years, lambda s, p: scan.read_facts(s, p, spec))
    else:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{paths[0]}/facts")
        nested = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
        facts = scan.read_facts(spark, [f"{p}/facts" for p in paths] if nested else paths, spec)
        if a.years:
            facts = scan.in_years(facts, a.years)
    path = a.meta or f"{paths[0]}/meta"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return facts, (scan.read_table(spark, path) if path.endswith((".csv", ".json")) else spark.read.parquet(path)) if there else None


def _sites(spark: SparkSession, a: argparse.Namespace, meta: DataFrame) -> DataFrame:
    if a.command == "region":
        return select.in_region(meta, a.region, a.column)
    if a.command == "box":
        return select.in_box(meta, *a.corners)
    if a.command == "sites":
        listed = scan.site_list(spark, a.sites)
        return listed if "gid" in listed.columns else spatial.lookup(listed.withColumn("point", F.monotonically_increasing_id()), meta)
    if a.gid is None and a.lat_lon is None:
        raise SystemExit("give --gid or --lat-lon")
    if a.gid is not None:
        return spark.range(1).select(F.lit(a.gid).alias("gid"))
    return spatial.lookup(spark.createDataFrame([(0, *a.lat_lon)], "point long, latitude double, longitude double"), meta)


def run(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or session(a.master)
    spec = PRESETS[a.kind]
    facts, meta = _load(spark, a)
    if a.command == "stats":
        out = stats.stats(with_dataset(facts, a.dataset, spec), a.dataset, a.statistics, a.period, a.mask_zeros)
        out = stats.widened(out, a.statistics) if a.wide else out
        sink.write_statistics(stats.with_meta(out, meta) if meta is not None else out, a.out, f"{a.dataset}_{a.period}")
    elif a.command == "means":
        sink.write_statistics(stats.means_map(with_dataset(facts, a.dataset, spec), meta, a.dataset, a.year), a.out, f"{a.dataset}_means")
    elif a.command == "wind-rose":
        speed, direction = f"windspeed_{a.height:g}m", f"winddirection_{a.height:g}m"
        rows = with_dataset(with_dataset(facts, speed, PRESETS["wind"]), direction, PRESETS["wind"])
        rose = jointpd.wind_rose(rows, F.col(speed), F.col(direction), a.speed_bins, a.direction_bins)
        rose.write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command in ("site", "region", "box", "sites"):
        rows = select.at_sites(with_dataset(facts, a.dataset, spec), _sites(spark, a, meta))
        if a.timestep:
            rows = select.timestep_map(rows, meta, a.dataset, a.timestep)
        else:
            rows = rows.select("gid", "ts", a.dataset)
        rows.write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command == "site-model":
        sites = meta
        if a.gids:
            sites = meta.where(F.col("gid").isin(a.gids))
        elif a.lat_lon:
            found = spatial.lookup(spark.createDataFrame([(0, *a.lat_lon)], "point long, latitude double, longitude double"), meta)
            sites = meta.join(found.select("gid"), "gid", "left_semi")
        table = site_model.loaded(select.at_sites(facts, sites), a.technology, height=a.height, meta=meta)
        sink.write_site_files(site_model.site_table(table), sites, a.out if "://" in a.out else f"file://{a.out}", a.technology.startswith("wind")).collect()
    elif a.command == "rechunk":
        layout.relaid(facts, a.out, {k: tuple(v) for k, v in a.dtypes.items()}, a.height, spec, a.resolution_seconds)
    else:
        parts = [facts, *[scan.read_facts(spark, p, spec) for p in a.others]]
        (scan.combined_times(parts) if a.axis == "time" else scan.combined_sites(parts)).write.parquet(a.out)


if __name__ == "__main__":
    run()
