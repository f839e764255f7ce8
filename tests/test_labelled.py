"""Labelled datasets over files, and streams that are replayed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aeolith.errors import ResourceKeyError, ResourceRuntimeError
from aeolith.sources import labelled, sink
from aeolith.streaming.stats import latest, upserted, windowed_stats


@pytest.fixture(scope="module")
def folder(facts, meta, tmp_path_factory):
    """A variable in two files of different scales, one by time, one by site."""
    root = tmp_path_factory.mktemp("labelled")
    cut = F.lit("2012-02-01").cast("timestamp_ntz")
    values = facts.select("gid", "ts", F.col("windspeed_80m").alias("v"))
    sink.scaled(values.where(F.col("ts") < cut), {"v": {"dtype": "smallint", "scale_factor": 10, "units": "m s-1"}}).write.parquet(f"{root}/a")
    sink.scaled(values.where(F.col("ts") >= cut), {"v": {"dtype": "int", "scale_factor": 1000, "units": "m s-1", "height": 80}}).write.parquet(f"{root}/b")
    facts.select("ts", F.hour("ts").cast("double").alias("h")).distinct().write.parquet(f"{root}/times")
    meta.select("gid", F.col("timezone").alias("zone")).write.parquet(f"{root}/sites")
    return str(root)


def test_files_are_unscaled_each_by_its_own(spark, folder, facts, meta):
    data = labelled.open_files(spark, [f"{folder}/{n}" for n in ("a", "b", "times", "sites")], meta=meta)
    assert {n: v.dims for n, v in data.variables.items()} == {"v": ("gid", "ts"), "h": ("ts",), "zone": ("gid",)}
    assert data.variable("v").attributes == {"units": "m s-1", "height": 80} and data["v"].schema["v"].metadata == data.variable("v").attributes
    rows = data.table("h", "v", "zone", coordinates=True).collect()
    assert len(rows) == 4 * 48 and rows[0].asDict().keys() == {"gid", "ts", "h", "v", "zone", "latitude", "longitude"}
    assert all(r.v == r.gid * 10 + r.ts.hour and r.h == r.ts.hour and r.zone == r.gid - 7 and r.latitude == 40 + r.gid for r in rows)
    assert data.table("zone").count() == 4
    with pytest.raises(ResourceRuntimeError):
        data.table("zone", "h")
    with pytest.raises(ResourceKeyError):
        data.table("nope")


def test_files_that_disagree_are_an_error(spark, folder, facts, tmp_path):
    odd = facts.select("gid", "ts", F.col("windspeed_80m").alias("v", metadata={"units": "knots"}))
    odd.write.parquet(f"{tmp_path}/units")
    facts.select("ts", F.lit(1.0).alias("v")).write.parquet(f"{tmp_path}/dims")
    facts.select(F.lit(1.0).alias("v")).write.parquet(f"{tmp_path}/none")
    for other in ("units", "dims", "none"):
        with pytest.raises(ResourceRuntimeError):
            labelled.open_files(spark, [f"{folder}/a", f"{tmp_path}/{other}"])


def test_stream_in_batches_equals_all_at_once(spark, tmp_path):
    """Late rows change windows that were given before; rows behind the watermark do not; a repeated batch counts once."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, at(0), 1.0), (1, at(5), 9.0), (2, at(3), 4.0)], [(1, at(7), 2.0), (2, at(30), 8.0)], [(1, at(1), 5.0), (2, at(31), 6.0)], [(1, at(200), 3.0)], [(1, at(202), 1.0)], [(1, at(2), 100.0), (1, at(201), 7.0)]]
    for rows in files:
        spark.createDataFrame(rows, "gid long, ts timestamp, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kind = "gid long, ts timestamp, x double"

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        upserted(windowed_stats(stream, "x", "1 day", "2 days", median=True), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {(r.gid, r.start): (r.n, r["median"], r["mean"]) for r in latest(spark, f"{tmp_path}/out").collect()}

    first = run()
    on_time = spark.createDataFrame([r for rows in files for r in rows if r[2] != 100], kind)
    want = {(r.gid, r.start): (r.n, r["median"], r["mean"]) for r in windowed_stats(on_time, "x", "1 day", "2 days", median=True).collect()}
    assert first == want and first[1, at(0)] == (4, 3.5, 4.25)
    assert run() == first
