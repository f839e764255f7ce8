import csv
import glob
import os

import pytest

from aeolith.cli import run
from aeolith.sources import sink


@pytest.fixture(scope="module")
def resource(facts, meta, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("resource") / "wind")
    sink.write_profiles(facts, path, None, meta)
    return path


def rows(path):
    """Of a file (statistics) or of the files of a folder."""
    return [r for f in ([path] if os.path.isfile(path) else sorted(glob.glob(f"{path}/*.csv"))) for r in csv.DictReader(open(f))]


def test_stats_and_means(spark, resource, tmp_path):
    run([resource, "--kind", "wind", "--out", f"{tmp_path}/s.csv", "stats", "--dataset", "windspeed_90m", "--period", "monthly", "--statistics", "mean,stdev"], spark)
    out = rows(f"{tmp_path}/s.csv")
    assert len(out) == 8 and {"gid", "month", "mean", "stdev", "latitude"} <= set(out[0])
    run([resource, "--kind", "wind", "--out", f"{tmp_path}/m.csv", "means", "--dataset", "windspeed_80m"], spark)
    assert len(rows(f"{tmp_path}/m.csv")) == 4


def test_extraction(spark, resource, tmp_path):
    base = [resource, "--kind", "wind", "--out", f"{tmp_path}/x.csv"]
    run([*base, "region", "--region", "CO", "--dataset", "windspeed_80m"], spark)
    assert len(rows(f"{tmp_path}/x.csv")) == 96
    run([*base, "site", "--lat-lon", "41.1,-103.9", "--dataset", "windspeed_80m"], spark)
    assert {r["gid"] for r in rows(f"{tmp_path}/x.csv")} == {"1"}
    run([*base, "site", "--gid", "0", "--dataset", "windspeed_80m"], spark)
    assert {r["gid"] for r in rows(f"{tmp_path}/x.csv")} == {"0"}
    run([*base, "box", "--corners", "40,-105", "42,-103", "--dataset", "windspeed_80m", "--timestep", "2012-01-31 05:00:00"], spark)
    assert len(rows(f"{tmp_path}/x.csv")) == 3
    with pytest.raises(SystemExit):
        run([*base, "site", "--dataset", "windspeed_80m"], spark)


def test_layout_commands(spark, resource, tmp_path):
    run([resource, "--kind", "wind", "--out", f"{tmp_path}/r", "rechunk", "--height", "100", "--resolution-seconds", "10800"], spark)
    assert spark.read.parquet(f"{tmp_path}/r").count() == 64
    run([resource, "--kind", "wind", "--out", f"{tmp_path}/c", "combine", "--others", f"{resource}/facts", "--axis", "sites"], spark)
    assert spark.read.parquet(f"{tmp_path}/c").select("gid").distinct().count() == 8


def test_domains_of_waves(spark, facts, meta, tmp_path):
    """The yearly files of one domain, of its buoys, and of some years."""
    for folder, years, height in (("West_Coast", (2009, 2010), 2.0), ("virtual_buoy/West_Coast", (2010,), 3.0)):
        for y in years:
            facts.selectExpr("gid", f"ts + INTERVAL '{y - 2012}' YEAR AS ts", f"{height}D + {y % 10} AS energy_period").write.parquet(f"{tmp_path}/wave/{folder}/wave_{y}.parquet")
    meta.write.parquet(f"{tmp_path}/meta")

    def got(*options):
        run([f"{tmp_path}/wave", "--kind", "wave", "--domain", "West_Coast", "--meta", f"{tmp_path}/meta", "--out", f"{tmp_path}/o.csv", *options, "site", "--gid", "1", "--dataset", "energy_period"], spark)
        out = rows(f"{tmp_path}/o.csv")
        return len(out), {float(r["energy_period"]) for r in out}

    assert got() == (96, {11.0, 2.0}) and got("--years", "2010") == (48, {2.0}) and got("--buoy") == (48, {3.0})
    with pytest.raises(SystemExit):
        run([f"{tmp_path}/wave", "--buoy", "--out", "x", "site", "--gid", "1", "--dataset", "energy_period"], spark)
