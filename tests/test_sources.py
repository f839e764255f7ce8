import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from aeolith.errors import ResourceKeyError, ResourceRuntimeError, ResourceWarning
from aeolith.sources import layout, scan, sink
from aeolith.sources.catalog import SOLAR, WIND, Catalog, coordinate_columns, describe, parse_name


def test_names_and_heights():
    assert parse_name("windspeed_100m") == ("windspeed", 100.0)
    assert parse_name("temperature_-2.5m") == ("temperature", -2.5)
    assert parse_name("ghi") == ("ghi", None)
    c = Catalog(("gid", "ts", "windspeed_80m", "windspeed_100m", "pressure_0m", "wind/u_10m"), WIND)
    assert c.heights()["windspeed"] == {80.0: "windspeed_80m", 100.0: "windspeed_100m"}
    assert c.nearest("windspeed", 85) == ([80.0, 100.0], False)
    assert c.groups == ["wind"] and c.in_group("wind").datasets == ["u_10m"]
    with pytest.raises(ResourceKeyError):
        c.column("humidity_10m")


def test_single_height_lapses_or_warns(spark):
    c = Catalog(("gid", "ts", "pressure_0m", "windspeed_100m"), WIND)
    spark.range(1).select(F.lit(1e5).alias("pressure_0m")).select(c.column("pressure_100m"))
    with pytest.warns(ResourceWarning):
        c.column("windspeed_50m")
        assert c.wind_height(50) == 100


def test_coordinate_columns():
    assert coordinate_columns(["gid", "Lat", "LONGITUDE"]) == ("Lat", "LONGITUDE")
    with pytest.raises(ResourceKeyError):
        coordinate_columns(["lat", "latitude", "lon"])


def test_attributes_by_priority_and_nan_as_null(spark):
    df = spark.createDataFrame([(0, 1234, float("nan"))], "gid long, ghi int, dni double").select("gid", F.col("ghi").alias("ghi", metadata={"psm_scale_factor": 100, "psm_units": "W"}), "dni")
    assert scan.normalised(df, SOLAR).first()["ghi"] == pytest.approx(12.34)
    assert scan.normalised(df, SOLAR).first()["dni"] is None
    assert {r.dataset: (r.scale_factor, r.units) for r in describe(df, SOLAR).collect()}["ghi"] == (100.0, "W")


def test_year_of_names():
    assert scan.year_of("site_100_wind_2012.parquet") == 2012
    assert scan.year_of("a_2010_b_2013.parquet") == 2013
    assert scan.year_of("nothing.parquet", required=False) is None
    with pytest.raises(ResourceRuntimeError):
        scan.year_of("nothing.parquet")


def test_paths(tmp_path, spark):
    assert scan.path_kind("s3a://b/x.parquet") == "store" and scan.path_kind("/a/*.parquet") == "local-many"
    with pytest.raises(OSError):
        scan.require_writable("s3://b/x", "w")
    with pytest.raises(ResourceRuntimeError):
        scan.expand(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        scan.expand(spark, f"{tmp_path}/*.parquet")


def test_write_read_and_compose(spark, facts, meta, tmp_path):
    sink.write_profiles(facts, f"{tmp_path}/a", {"windspeed_80m": {"dtype": "smallint", "scale_factor": 10}}, meta, {"run": {"n": 1}})
    back = scan.read_facts(spark, f"{tmp_path}/a/facts", WIND)
    assert back.where("gid = 1 AND hour(ts) = 5").select("windspeed_80m").first()[0] == pytest.approx(15.0)
    assert dict(scan.read_facts(spark, f"{tmp_path}/a/facts", WIND, raw=True).dtypes)["windspeed_80m"] == "smallint"
    assert json.loads(spark.read.parquet(f"{tmp_path}/a/configs").first().config) == {"n": 1}
    for y in (2012, 2013):
        facts.write.parquet(f"{tmp_path}/years/wind_{y}.parquet")
    paths = scan.expand(spark, f"{tmp_path}/years/*.parquet")
    assert scan.by_year(spark, paths, [2013]).count() == facts.count()
    with pytest.raises(ResourceRuntimeError):
        scan.by_year(spark, paths, [2015])


def test_by_dataset_checks_and_last_wins(facts):
    other = facts.select("gid", "ts", (F.col("windspeed_80m") * 0).alias("windspeed_80m"))
    assert scan.by_dataset([facts, other], check=True).agg(F.max("windspeed_80m")).first()[0] == 0
    with pytest.raises(ResourceRuntimeError):
        scan.by_dataset([facts, other.where("gid > 0")], check=True)


def test_by_time_refuses_overlap(facts):
    with pytest.raises(ResourceRuntimeError):
        scan.by_time([facts, facts.limit(3)])


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/s.csv"
    with open(path, "w") as f:
        f.write("gid,latitude\n3,40.5\n")
    assert scan.site_list(spark, path).first().gid == 3
    with pytest.raises(ValueError):
        scan.site_list(spark, {"latitude": [1.0]})
    with pytest.raises(ValueError):
        scan.read_table(spark, "x.txt")


def test_retries():
    calls = []

    @scan.retried(3, 0)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert f() == 7 and len(calls) == 3


def test_site_files_and_headers(spark, facts, meta, tmp_path):
    out = sink.write_site_files(facts, meta, f"file://{tmp_path}/sites").collect()
    assert sorted(r.file for r in out) == [f"{g}.csv" for g in range(4)]
    lines = open(f"{tmp_path}/sites/2.csv").read().splitlines()
    assert "Location ID" in lines[0] and len(lines) == 3 + 48
    assert sink.header({"gid": 1, "state": "a,b"}, wind=True) == ["Location ID,1,State,ab"]
    assert [len(b) for b in sink.batches(list(range(10)), 4)] == [3, 3, 2, 2]


def test_sinks(spark, facts, meta, tmp_path):
    sink.write_json({"b": 1}, f"{tmp_path}/x.json")
    assert json.load(open(f"{tmp_path}/x.json")) == {"b": 1}
    assert sink.write_statistics(facts.groupBy("gid").count(), str(tmp_path), "me*an").endswith("mean.csv")
    assert os.path.exists(f"{tmp_path}/mean.csv")
    assert sink.differs(facts, facts.withColumn("windspeed_80m", F.col("windspeed_80m") + 1), "windspeed_80m")
    assert not sink.differs(facts, facts, "windspeed_80m")
    sink.check_shape(facts, meta, facts.select("ts").distinct())
    with pytest.raises(ValueError):
        sink.check_shape(facts.limit(5), meta, facts.select("ts").distinct())
    assert dict(sink.shrink_meta(meta).dtypes)["gid"] == "smallint"


def test_layout(facts, tmp_path, spark):
    assert layout.timeseries_chunk(8760, 10**6, "float") == (1344, 373)
    assert layout.array_chunk((10, 10)) is None
    assert layout.at_height(facts, 100, WIND).columns == ["gid", "ts", "windspeed_100m"]
    out = layout.relaid(facts, f"{tmp_path}/r", {"windspeed_80m": ("smallint", 100)}, resolution_seconds=3 * 3600, files=2)
    assert out.count() == 4 * 16 and dict(out.dtypes)["windspeed_80m"] == "smallint"
    with pytest.raises(ValueError):
        layout.relaid(facts, f"{tmp_path}/q", resolution_seconds=60)


def test_store_is_created_filled_and_updated(spark, tmp_path, facts, meta):
    path, times = f"file://{tmp_path}/store", facts.select("ts")
    sink.create_store(path, meta, times, {"version": 1})
    values = facts.select("gid", "ts", F.col("windspeed_80m").alias("v"))
    sink.write_dataset(path, values, "v", {"dtype": "smallint", "scale_factor": 10, "units": "m s-1"})
    back = sink.read_store(spark, path, ["v"])
    assert dict(back.dtypes)["v"] == "smallint" and back.schema["v"].metadata["units"] == "m s-1"
    assert back.where("gid = 3 AND hour(ts) = 5").first()["v"] == 350
    # a whole number of stored steps changes nothing
    assert not sink.update_dataset(path, values.withColumn("v", F.col("v") + 0.01), "v")
    assert sink.update_dataset(path, values.withColumn("v", F.col("v") + 1), "v")
    assert sink.read_store(spark, path, ["v"]).where("gid = 3 AND hour(ts) = 5").first()["v"] == 360
    assert sorted(os.listdir(tmp_path / "store" / "datasets")) == ["v"]
    with pytest.raises(ValueError):
        sink.write_dataset(path, values.where("gid > 0").withColumnRenamed("v", "w"), "w")
    sink.write_dataset(path, values.withColumn("u", F.col("v") * 2), "u")
    both = sink.read_store(spark, path, ["v", "u"])
    assert both.count() == facts.count() and both.columns == ["gid", "ts", "v", "u"]


def test_store_checks_rows_as_it_writes_them(spark, tmp_path, facts, meta):
    """Repeated rows in place of absent ones, and rows without a time, are errors that leave nothing; no pass counts distinct rows."""
    path = f"file://{tmp_path}/store"
    sink.create_store(path, meta, facts.select("ts"))
    values = facts.select("gid", "ts", F.col("windspeed_80m").alias("v"))
    first = F.col("ts") == facts.agg(F.min("ts")).first()[0]
    for wrong in (
        values.where(~(first & (F.col("gid") == 2))).unionByName(values.where(first & (F.col("gid") == 1))),
        values.withColumn("ts", F.when(~(first & (F.col("gid") == 2)), F.col("ts"))),
        values.unionByName(values.where(first)),
    ):
        with pytest.raises(ValueError, match="192 places"):
            sink.write_dataset(path, wrong, "v")
        assert not (tmp_path / "store" / "datasets").exists() or not os.listdir(tmp_path / "store" / "datasets")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sink, "check_shape", None)
        sink.write_dataset(path, values, "v")
        whole, seen = sink.differs, []
        patch.setattr(sink, "differs", lambda old, new, name: seen.append(old.count()) or whole(old, new, name))
        # the first site has changed; then only another has; then none
        assert sink.update_dataset(path, values.withColumn("v", F.col("v") + 1), "v") and seen == [48]
        some = sink.read_store(spark, path, ["v"]).first().gid
        only = values.withColumn("v", F.when(F.col("gid") != some, F.col("v")).otherwise(F.col("v") + 1))
        assert sink.update_dataset(path, only, "v") and seen == [48, 48, 192]
        assert not sink.update_dataset(path, only, "v")
        with pytest.raises(ValueError):
            sink.update_dataset(path, only.where("gid < 3"), "v")
    assert sink.read_store(spark, path, ["v"]).exceptAll(only).count() == 0


def test_readers_see_the_state_before_or_after(spark, tmp_path, facts, meta, monkeypatch):
    """Between the writing of a version and its commit the old state is whole; two writers do not lose one's work."""
    path = f"file://{tmp_path}/store"
    sink.create_store(path, meta, facts.select("ts"))
    values = facts.select("gid", "ts", F.col("windspeed_80m").alias("v"))
    sink.declare_dataset(path, spark, "later", "smallint", {"scale_factor": 10})
    assert sink.read_store(spark, path, ["later"]).where("later IS NULL").count() == 4 * 48
    first = sink.write_dataset(path, values, "v")
    seen = []
    commit = sink._commit

    def watched(session, where, changes, last):
        seen.append(sink.read_store(session, where, ["v"]).agg(F.max("v")).first()[0])
        out = commit(session, where, changes, last)
        seen.append(sink.read_store(session, where, ["v"]).agg(F.max("v")).first()[0])
        return out

    monkeypatch.setattr(sink, "_commit", watched)
    before = sink.read_store(spark, path, ["v"])
    assert sink.update_dataset(path, values.withColumn("v", F.col("v") + 100), "v")
    assert seen == [53.0, 153.0] and before.agg(F.max("v")).first()[0] == 53.0
    assert sink.read_store(spark, path, ["v"], commit=first).agg(F.max("v")).first()[0] == 53.0
    monkeypatch.setattr(sink, "_commit", commit)
    with pytest.raises(ResourceRuntimeError):
        sink._commit(spark, path, {}, first)
    sink.write_dataset(path, values.withColumnRenamed("v", "later"), "later")
    both = sink.read_store(spark, path, ["later", "v"])
    assert dict(both.dtypes)["later"] == "smallint" and both.schema["later"].metadata == {"scale_factor": 10} and both.agg(F.max("later"), F.max("v")).first() == (530, 153.0)
    assert len(sink.vacuum(spark, path)) == 1 and sink.read_store(spark, path, ["v"]).count() == 4 * 48
    with pytest.raises(FileNotFoundError):
        sink.read_store(spark, path, ["v"], commit=first)
    with pytest.raises(ResourceRuntimeError):
        sink.read_store(spark, path, ["nope"])


def test_statistics_are_one_file(spark, tmp_path):
    import csv
    import json

    table = spark.createDataFrame([(i, f'a "{i}", b', [float(i)]) for i in range(50, 0, -1)], "gid long, name string, fit array<double>").repartition(7)
    path = sink.write_statistics(table, str(tmp_path / "out"), "wind*stats")
    assert path.endswith("windstats.csv") and os.path.isfile(path)
    rows = list(csv.reader(open(path)))
    assert rows[0] == ["gid", "name", "fit"] and rows[1:] == [[str(i), f'a "{i}", b', f"[{i}.0]"] for i in range(1, 51)]
    path = sink.write_statistics(table, str(tmp_path / "x.json"))
    assert [json.loads(line)["gid"] for line in open(path)] == list(range(1, 51))


def test_clustered_files_skip_row_groups(spark, tmp_path):
    """A filter on site and period reads few of the rows, in either order of importance."""
    rows = spark.range(200_000).selectExpr("id % 400 AS gid", "TIMESTAMP_NTZ '2012-01-01' + make_interval(0, 0, 0, 0, CAST(id DIV 400 AS int)) AS ts", "rand(1) AS v", "uuid() AS u")
    out = layout.clustered(rows, f"file://{tmp_path}/clustered", 40, megabytes=0.25)
    part = out.where(F.col("gid").between(100, 110) & layout.during("2012-01-05", "2012-01-07"))
    assert part.count() == 11 * 48 and part.agg(F.min("ts"), F.max("ts")).first() == (dt.datetime(2012, 1, 5), dt.datetime(2012, 1, 6, 23))
    assert layout.rows_scanned(part) < 25_000 and layout.rows_scanned(out.where("gid = 3")) < 60_000 and layout.rows_scanned(out) == 200_000
    assert layout.clustered(rows.limit(0), f"file://{tmp_path}/none", 2).count() == 0
