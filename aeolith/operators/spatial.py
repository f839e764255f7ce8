"""Nearest sites, regridding, resolutions and rasters."""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeolith.errors import ResourceValueError
from aeolith.session import shared_path

from .ordered import interpolate_in_time

#: Most sites that each task compares with all its points; more are joined by ranges of a space-filling curve.  Both give the same rows.
ARRAY_SITES = 2048
#: Sites of a range, unless that makes more than so many ranges; each task knows the extents of all.
RANGE_SITES, RANGES = 1024, 4096
#: About so many sites, by their hashes, show where to cut ranges of equal population; all sites are searched.
CUT_SITES = 1_000_000
#: Points of a range that one task compares with its sites.
RANGE_POINTS = 20_000
#: Weights that go to all tasks when regridding (24 bytes each); more are stored.
PACKED_WEIGHTS = 2_000_000
#: Stored weights that a task holds at once, and facts that meet them.
BLOCK_WEIGHTS, BLOCK_FACTS = 500_000, 500_000


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Euclidean distance in degrees, the measure of site lookups."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in radians, the measure of regridding."""
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(a) * F.cos(b) * t * t)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back, so that it is made once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


METRICS = {"planar": planar, "haversine": haversine}


def nearest(points: DataFrame, sites: DataFrame, k: int = 1, metric: str = "planar", point: str = "point") -> DataFrame:
    """(point, gid, distance, rank) of the k nearest sites of each point, nearer and then smaller gids first.

    Points and sites have latitude and longitude; null coordinates match nothing.
    Few sites (counted first) go to all tasks as arrays, without any shuffle of
    points.  More are cut into ranges of equal population along a space-filling curve,
    so crowded places have small ones; a point meets the ranges that its k nearest
    sites can be in, as bounds of their extents tell.  By haversine, longitudes meet at 180.
    """
    points = points.select(F.col(point).alias("point"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).dropna()
    sites = sites.select("gid", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude")).dropna()
    ranked = _by_array(points, sites, k, metric) if sites.limit(ARRAY_SITES + 1).count() <= ARRAY_SITES else _by_ranges(points, sites, k, metric)
    return ranked.select("point", F.posexplode("near").alias("rank", "n")).select("point", F.col("n.gid").alias("gid"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def _distances(metric: str, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """The same measures as the columns of METRICS, for all points (rows) and sites."""
    if metric == "planar":
        return np.sqrt((lat1[:, None] - lat2) * (lat1[:, None] - lat2) + (lon1[:, None] - lon2) * (lon1[:, None] - lon2))
    a, b = np.radians(lat1)[:, None], np.radians(lat2)
    s, t = np.sin((b - a) / 2), np.sin((np.radians(lon2) - np.radians(lon1)[:, None]) / 2)
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(s * s + np.cos(a) * np.cos(b) * t * t)))


def _by_array(points: DataFrame, sites: DataFrame, k: int, metric: str) -> DataFrame:
    few = sites.orderBy("gid").toArrow()  # at most ARRAY_SITES rows
    gid = few["gid"].combine_chunks()
    lat, lon = few["latitude"].to_numpy(), few["longitude"].to_numpy()
    k = min(k, len(gid))

    def near(batches):
        for batch in batches:
            plat, plon = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            order, distance = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
            for i in range(0, batch.num_rows if k else 0, 256):
                d = _distances(metric, plat[i : i + 256], plon[i : i + 256], lat, lon)
                # of equally near sites the smaller gid, which comes first
                order.append(_nearest_places(d, k))
                distance.append(np.take_along_axis(d, order[-1], 1))
            order, distance = np.concatenate(order), np.concatenate(distance)
            flat = pa.StructArray.from_arrays([pa.array(distance.ravel()), gid.take(pa.array(order.ravel()))], ["distance", "gid"])
            offsets = pa.array(np.arange(batch.num_rows + 1) * k, pa.int32())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["point", "near"])

    kinds = {f: points.schema[f].dataType.simpleString() for f in ("point",)} | {"gid": sites.schema["gid"].dataType.simpleString()}
    rows = points.select("point", F.col("plat").cast("double"), F.col("plon").cast("double"))
    return rows.mapInArrow(near, f"point {kinds['point']}, near array<struct<distance:double,gid:{kinds['gid']}>>")


def _on_curve(box: tuple[float, float, float, float], cuts: list[float] | None = None):
    """Adds ``code``, the place on a Z-order curve through the box, 26 bits a side: half a metre on the globe, and exact as a double; or ``range``, how many of the sorted cuts are up to it."""
    south, north, west, east = box
    cut = None if cuts is None else np.asarray(cuts, float)

    def spread(x: np.ndarray) -> np.ndarray:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | x << shift) & mask
        return x

    def coded(batches):
        for batch in batches:
            side = []
            for name, low, high in (("latitude", south, north), ("longitude", west, east)):
                x = batch.column(name).to_numpy(zero_copy_only=False)
                side.append(spread((np.clip((x - low) / max(high - low, 1e-300), 0, 1) * (2**26 - 1)).astype(np.int64)))
            code = side[0] << 1 | side[1]
            last, name = (code, "code") if cut is None else (np.searchsorted(cut, code, "right").astype(np.int32), "range")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last)], [*batch.schema.names, name])

    return coded


def _at_least(metric: str, lat: np.ndarray, lon: np.ndarray, box: np.ndarray) -> np.ndarray:
    """For points (rows) and extents (south, north, west, east): no place inside is nearer."""
    south, north, west, east = box
    lat, lon = lat[:, None], lon[:, None]
    up = np.maximum(0, np.maximum(south - lat, lat - north))
    if metric == "planar":
        across = np.maximum(0, np.maximum(west - lon, lon - east))
        return np.sqrt(up * up + across * across)
    turned = (lon - west) % 360
    across = np.where(turned <= east - west, 0, np.minimum(turned - (east - west), 360 - turned))
    # a meridian is nearest on the circle through the point that meets it at a right angle, or at a pole
    beside = np.arcsin(np.minimum(1, np.cos(np.radians(lat)) * np.sin(np.radians(np.minimum(across, 90)))))
    return np.maximum(np.radians(up), beside) * (1 - 1e-12)


def _extents(n: int, k: int):
    """(range, extent, k of its sites at most) of the sites that a task holds, n ranges."""
    low, high = np.minimum, np.maximum

    def extents(batches):
        box = [np.full(n, x) for x in (np.inf, -np.inf, np.inf, -np.inf)]
        some: list[list] = [[] for _ in range(n)]
        short = np.ones(n, bool)
        for batch in batches:
            at, lat, lon = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("range", "latitude", "longitude"))
            for side, bound, x in zip(box, (low, high, low, high), (lat, lat, lon, lon), strict=True):
                bound.at(side, at, x)
            for i in np.flatnonzero(short[at]):
                r = at[i]
                if short[r]:
                    some[r].append({"latitude": lat[i], "longitude": lon[i]})
                    short[r] = len(some[r]) < k
        there = np.flatnonzero(box[0] <= box[1])
        kind = pa.list_(pa.struct([("latitude", pa.float64()), ("longitude", pa.float64())]))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(side[there]) for side in box), pa.array([some[r] for r in there], kind)], ["range", "e0", "e1", "e2", "e3", "some"])

    return extents


def _by_ranges(points: DataFrame, sites: DataFrame, k: int, metric: str) -> DataFrame:
    n, *box = sites.agg(F.count("*"), F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude")).first()
    gid, point = (f.schema[c].dataType.simpleString() for f, c in ((sites, "gid"), (points, "point")))
    # points at one place have the same sites: one of them asks for all
    points = points.select("point", F.col("plat").cast("double"), F.col("plon").cast("double"))
    points = stored(points.withColumn("__asks", F.min("point").over(Window.partitionBy("plat", "plon"))), "points")
    parts = max(1, min(RANGES, -(-n // RANGE_SITES)))
    cuts = []
    if parts > 1:  # where ranges are cut changes no result: of many sites, those of some hashes show how they lie
        shown = sites.where(F.pmod(F.xxhash64("gid"), F.lit(max(1, n // CUT_SITES))) == 0)
        coded = shown.mapInArrow(_on_curve(tuple(box)), f"gid {gid}, latitude double, longitude double, code long")
        cuts = sorted(set(coded.approxQuantile("code", [i / parts for i in range(1, parts)], 0.1 / parts)))
    ranged = sites.mapInArrow(_on_curve(tuple(box), cuts), f"gid {gid}, latitude double, longitude double, range int")
    known = ranged.mapInArrow(_extents(len(cuts) + 1, k), "range int, e0 double, e1 double, e2 double, e3 double, some array<struct<latitude:double,longitude:double>>")
    known = known.groupBy("range").agg(F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("e2").alias("e2"), F.max("e3").alias("e3"), F.slice(F.flatten(F.collect_list("some")), 1, k).alias("some"))
    known = known.orderBy("range").collect()  # at most RANGES rows, each with k sites
    numbers, boxes = np.array([r["range"] for r in known]), np.array([[r[f"e{i}"] for r in known] for i in range(4)], float)
    # k sites of a range bound the distance of the k nearest of all
    full = [i for i, r in enumerate(known) if len(r.some) == k]
    some = np.array([[(s.latitude, s.longitude) for s in known[i].some] for i in full], float).reshape(-1, 2)
    step = max(1, min(256, 2**20 // max(1, len(some))))

    def candidates(batches):
        for batch in batches:
            plat, plon = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            rows, ranges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(0, batch.num_rows, step):
                lat, lon = plat[i : i + step], plon[i : i + step]
                reach = np.full(len(lat), np.inf)
                if full:
                    reach = _distances(metric, lat, lon, some[:, 0], some[:, 1]).reshape(len(lat), -1, k).max(2).min(1)
                p, r = np.nonzero(_at_least(metric, lat, lon, boxes) <= reach[:, None])
                rows.append(p + i)
                ranges.append(numbers[r])
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(np.concatenate(ranges).astype(np.int32))], ["point", "plat", "plon", "range"])

    asking = points.where("point = __asks").select("point", "plat", "plon").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = stored(asking.mapInArrow(candidates, f"point {point}, plat double, plon double, range int"), "asked")
    shares = F.broadcast(asked.groupBy("range").agg(F.ceil(F.count("*") / RANGE_POINTS).cast("int").alias("shares")))  # at most RANGES rows
    asked = asked.join(shares, "range").withColumn("share", F.pmod(F.xxhash64("point"), F.col("shares")).cast("int")).drop("shares")
    # only sites of ranges that are asked for go on; of those at one place only the k smallest can be among the nearest
    place = Window.partitionBy("latitude", "longitude").orderBy("gid")
    dealt = ranged.join(shares, "range").withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k).drop("__n")
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    near = asked.groupBy("range", "share").cogroup(dealt.groupBy("range", "share")).applyInArrow(_compared(k, metric), f"point {point}, distance double, gid {gid}")
    near = near.groupBy("point").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "gid"))), 1, k).alias("near"))
    return points.select("point", "__asks").join(near.withColumnRenamed("point", "__asks"), "__asks").select("point", "near")


def _nearest_places(d: np.ndarray, m: int) -> np.ndarray:
    """For each row the places of its m smallest, of equal ones the first: a stable sort without the rest."""
    if m == 1:
        return d.argmin(1)[:, None]
    rows, columns = np.nonzero(d <= np.partition(d, m - 1, 1)[:, m - 1 : m])
    columns = columns[np.lexsort((columns, d[rows, columns], rows))]
    return columns[np.searchsorted(rows, np.arange(len(d)))[:, None] + np.arange(m)]


def _compared(k: int, metric: str):
    def compared(asked: pa.Table, sites: pa.Table) -> pa.Table:
        sites = sites.sort_by("gid")
        lat, lon, plat, plon = (t[c].to_numpy() for t, c in ((sites, "latitude"), (sites, "longitude"), (asked, "plat"), (asked, "plon")))
        m = min(k, len(lat)) if len(plat) else 0
        order, distance = [np.zeros((0, m), np.int64)], [np.zeros((0, m))]
        for i in range(0, len(plat) if m else 0, 256):
            d = _distances(metric, plat[i : i + 256], plon[i : i + 256], lat, lon)
            order.append(_nearest_places(d, m))
            distance.append(np.take_along_axis(d, order[-1], 1))
        of = pa.array(np.repeat(np.arange(len(plat)), m))
        return pa.table({"point": asked["point"].take(of), "distance": np.concatenate(distance).ravel(), "gid": sites["gid"].take(pa.array(np.concatenate(order).ravel()))})

    return compared


def distance_threshold(sites: DataFrame) -> Column:
    """1.05 sqrt(2) / 2 times the largest distance from a site to its nearest other one (0 if that is at the same place), as a scalar."""
    near = nearest(sites.withColumnRenamed("gid", "point"), sites, 2).where("gid <> point")
    return near.groupBy("point").agg(F.min("distance").alias("d")).agg((F.max("d") * 1.05 * math.sqrt(2) / 2).alias("threshold")).scalar()


def lookup(points: DataFrame, sites: DataFrame, check: bool = True, point: str = "point") -> DataFrame:
    """The nearest site of each point; points outside the extent, or further than the threshold, are an error."""
    found = nearest(points, sites, 1, "planar", point)
    if check:
        box = sites.agg(F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"))
        if points.join(F.broadcast(box)).where("latitude < s OR latitude > n OR longitude < w OR longitude > e").limit(1).count():
            raise ResourceValueError("points lie outside the extent of the sites")
        if found.where(F.col("distance") > distance_threshold(sites)).limit(1).count():
            raise ResourceValueError("points lie too far from any site")
    return found


def series_at(facts: DataFrame, meta: DataFrame, dataset: str, latitude: float, longitude: float, check: bool = True) -> DataFrame:
    """(ts, dataset) of the site nearest to a place."""
    place = facts.sparkSession.createDataFrame([(0, float(latitude), float(longitude))], "point long, latitude double, longitude double")
    near = F.broadcast(lookup(place, meta, check).select("gid"))  # one row
    return facts.join(near, "gid", "left_semi").select("ts", dataset)


def table_at(facts: DataFrame, meta: DataFrame, dataset: str, places: DataFrame, check: bool = True, point: str = "point") -> DataFrame:
    """(point, gid, ts, dataset) of the sites nearest to places; those of one site each have its rows."""
    near = lookup(places, meta, check, point).select("point", "gid")
    return facts.join(near, "gid").select(F.col("point").alias(point), "gid", "ts", dataset)


def regrid_weights(sites: DataFrame, targets: DataFrame, k: int = 4, min_distance: float = 1e-12, target: str = "target", own: bool = False) -> DataFrame:
    """(target, gid, weight): inverse distances of the k nearest sites, summing to 1.

    A site nearer than ``min_distance`` leaves all weight to the nearest.  With ``own``
    targets are named as the sites are: of equally near sites that of the target's name
    comes first.  Store the table to regrid more data with it.
    """
    near = nearest(targets, sites, k, "haversine", target)
    if own:
        near = _own_first(near, targets, sites, k, target)
    own = Window.partitionBy("point")
    close = F.min("distance").over(own) < min_distance
    inverse = F.when(close, (F.col("rank") == 1).cast("double")).otherwise(1 / F.greatest(F.col("distance"), F.lit(min_distance)))
    weighed = near.withColumn("w", inverse)
    return weighed.select(F.col("point").alias(target), "gid", (F.col("w") / F.sum("w").over(own)).alias("weight"))


def _own_first(near: DataFrame, targets: DataFrame, sites: DataFrame, k: int, target: str) -> DataFrame:
    """The k nearest by haversine with the site of the point's own name, which equal ones of smaller names may have kept out, before its equals."""
    t = targets.select(F.col(target).alias("point"), F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).dropna()
    same = t.join(sites.select("gid", "latitude", "longitude").dropna(), F.col("point") == F.col("gid"))
    same = same.select("point", "gid", haversine(F.col("plat"), F.col("plon"), F.col("latitude"), F.col("longitude")).alias("distance"))
    both = near.where("gid <> point").select("point", "gid", "distance").unionByName(same)
    order = Window.partitionBy("point").orderBy("distance", F.col("gid") != F.col("point"), "gid")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def regrid(facts: DataFrame, weights: DataFrame, dataset: str, target: str = "target") -> DataFrame:
    """Weighted sums of the neighbours' values at each time.

    Facts are shuffled once, by time, and each time's values are one vector.  Up to
    ``PACKED_WEIGHTS`` weights (counted first) go to all tasks as a sparse matrix.  Of more,
    targets with the same weights are one, blocks of the matrix are stored, each task reads
    one after the other for many times at once, and facts of sites without weights are left
    out.  A target has a row where any neighbour has one; null values do not count, and
    only they give null.
    """
    table = weights.select(F.col(target).alias("target"), "gid", F.col("weight").cast("double").alias("weight")).where("gid IS NOT NULL AND target IS NOT NULL")
    schema = f"target {table.schema['target'].dataType.simpleString()}, ts {facts.schema['ts'].dataType.simpleString()}, value double"
    rows = facts.select("gid", "ts", F.col(dataset).cast("double").alias("value"))
    if table.limit(PACKED_WEIGHTS + 1).count() > PACKED_WEIGHTS:
        out = _regrid_in_blocks(rows, table, schema)
    else:
        packed = table.orderBy("gid").toArrow()  # at most PACKED_WEIGHTS rows
        shared = rows.sparkSession.sparkContext.broadcast(_Weights(packed))
        out = rows.groupBy("ts").applyInArrow(lambda table: shared.value.at_time(table), schema)
    return out.select(F.col("target").alias(target), "ts", F.col("value").alias(dataset))


def _regrid_in_blocks(rows: DataFrame, table: DataFrame, schema: str) -> DataFrame:
    few = lambda df: F.broadcast(df) if df.limit(PACKED_WEIGHTS + 1).count() <= PACKED_WEIGHTS else df
    lists = stored(table.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("gid", "weight"))).alias("near")), "targets")
    kinds = stored(lists.groupBy("near").agg(F.min("target").alias("kind")), "kinds")
    members = stored(lists.join(kinds, "near").select("kind", F.col("target").alias("__target")), "members")
    cells = kinds.select(F.col("kind").alias("target"), F.inline("near"))
    blocks = max(1, -(-cells.count() // BLOCK_WEIGHTS))
    path = shared_path(rows.sparkSession, "weights")
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int"))
    dealt.repartition(min(blocks, 1000), "block").sortWithinPartitions("block", "gid").write.partitionBy("block").parquet(path)
    known = rows.join(few(cells.select("gid").distinct()), "gid", "left_semi")
    values = known.repartition("ts").sortWithinPartitions("ts").mapInArrow(_in_blocks(path, blocks), schema)
    return values.join(few(members), values["target"] == members["kind"]).select(F.col("__target").alias("target"), "ts", "value")


def _changes(values: pa.Array) -> np.ndarray:
    """Places of an array whose value is another than the one before."""
    now, before = values[1:], values[:-1]
    same = pc.fill_null(pc.equal(now, before), pa.scalar(False))
    return np.flatnonzero(~pc.or_(same, pc.and_(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)) + 1


def _whole_times(batches):
    """Tables of about BLOCK_FACTS facts sorted by time; none ends inside a time, so one may have more."""
    waiting, n = [], 0
    for batch in batches:
        if waiting and n >= BLOCK_FACTS:
            ends = _changes(pa.concat_arrays([waiting[-1].column("ts")[-1:], batch.column("ts")]))
            if len(ends):
                yield pa.Table.from_batches([*waiting, batch.slice(0, ends[0] - 1)])
                waiting, n, batch = [], 0, batch.slice(ends[0] - 1)
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def _in_blocks(path: str, blocks: int):
    def block(i: int):
        fs, root = pafs.FileSystem.from_uri(f"{path}/block={i}")
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return None
        return _Weights(pq.read_table(root, filesystem=fs, partitioning=None).sort_by("gid"))

    def in_blocks(batches):
        held = block(0) if blocks == 1 else None
        for table in _whole_times(batches):
            table = table.combine_chunks()
            starts = [0, *_changes(table["ts"].combine_chunks() if table["ts"].num_chunks != 1 else table["ts"].chunk(0)), table.num_rows]
            for i in range(blocks):
                weights = held or block(i)
                for a, b in pairwise(starts) if weights else ():
                    yield from weights.at_time(table.slice(a, b - a)).combine_chunks().to_batches()

    return in_blocks


class _Weights:
    """Weights by site: those of site i stand from first[i] to first[i + 1]."""

    def __init__(self, table: pa.Table):
        gid = table["gid"].to_numpy()
        self.gids, self.first = np.unique(gid, return_index=True)
        self.first = np.append(self.first, len(gid))
        coded = table["target"].combine_chunks().dictionary_encode()
        self.targets, self.column, self.weight = coded.dictionary, coded.indices.to_numpy(), table["weight"].to_numpy()

    def at_time(self, facts: pa.Table) -> pa.Table:
        gid, value = facts["gid"].to_numpy(), facts["value"].to_numpy()
        known = facts["value"].is_valid().to_numpy()
        site = np.minimum(np.searchsorted(self.gids, gid), max(len(self.gids) - 1, 0))
        there = np.flatnonzero(self.gids[site] == gid) if len(self.gids) else np.zeros(0, np.int64)
        first = self.first[site[there]]
        n = self.first[site[there] + 1] - first if len(there) else first
        cell = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        column, fact = self.column[cell], np.repeat(there, n)
        size = len(self.targets)
        counts = known[fact]
        rows, valued = np.bincount(column, minlength=size), np.bincount(column[counts], minlength=size)
        sums = np.bincount(column[counts], (self.weight[cell] * value[fact])[counts], minlength=size)
        at = np.flatnonzero(rows)
        time = pa.repeat(facts["ts"][0], len(at))
        return pa.table({"target": self.targets.take(pa.array(at)), "ts": time, "value": pa.array(sums[at], mask=valued[at] == 0)})


def store_weights(weights: DataFrame, path: str) -> None:
    """Keeps a table of weights for further data of the same sites and targets."""
    weights.write.mode("errorifexists").parquet(path)


def stored_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def regrid_onto(facts: DataFrame, sites: DataFrame, targets: DataFrame, dataset: str, k: int = 4, min_distance: float = 1e-12, target: str = "target", cache: str | None = None) -> DataFrame:
    """Values at the targets in one call; weights are read from ``cache`` if they are there, else stored there if it is given."""
    spark = facts.sparkSession
    if cache is None:
        return regrid(facts, regrid_weights(sites, targets, k, min_distance, target), dataset, target)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        store_weights(regrid_weights(sites, targets, k, min_distance, target), cache)
    return regrid(facts, stored_weights(spark, cache), dataset, target)


def with_low_resolution(high: DataFrame, high_sites: DataFrame, low: DataFrame, low_sites: DataFrame, datasets: list[str]) -> DataFrame:
    """High-resolution facts with datasets of the nearest low-resolution site, interpolated onto their times."""
    pairs = nearest(high_sites.withColumnRenamed("gid", "point"), low_sites, 1).select(F.col("point").alias("gid"), F.col("gid").alias("low_gid"))
    there = low.select(F.col("gid").alias("low_gid"), "ts", *datasets)
    out = high.join(pairs, "gid").join(there, ["low_gid", "ts"], "left").drop("low_gid")
    for d in datasets:
        out = interpolate_in_time(out, d)
    return out


def raster(sites: DataFrame, target: tuple[float, float], shape: tuple[int, int], max_step: int = 50) -> DataFrame:
    """(row, col, gid) of a raster whose southwest corner is the site nearest to the target; row 0 is the north.

    The nine sites around the target give the steps of the grid; beyond
    ``max_step`` rows or columns the raster is walked in tiles, each with steps of
    its own.  A raster that the sites do not fill is an error.
    """
    rows, cols = shape
    out, start = [], target
    tiles = [(r, c) for r in range(0, rows, max_step) for c in range(0, cols, max_step)]
    corners: dict[tuple[int, int], tuple[float, float]] = {(0, 0): start}
    for r, c in tiles:
        size = (min(max_step, rows - r), min(max_step, cols - c))
        origin, dx, dy = _steps(sites, corners[r, c])
        corners[r + max_step, c] = tuple(origin + dy * size[0])
        corners[r, c + max_step] = tuple(origin + dx * size[1])
        inverse = np.linalg.inv(np.stack([dy, dx], 1))
        north, east = F.col("latitude") - float(origin[0]), F.col("longitude") - float(origin[1])
        up = F.bround(north * float(inverse[0, 0]) + east * float(inverse[0, 1]), 0).cast("int")
        right = F.bround(north * float(inverse[1, 0]) + east * float(inverse[1, 1]), 0).cast("int")
        inside = sites.select("gid", up.alias("up"), right.alias("right")).where(F.col("up").between(0, size[0] - 1) & F.col("right").between(0, size[1] - 1))
        out.append(inside.select((F.lit(rows - 1) - (F.col("up") + r)).alias("row"), (F.col("right") + c).alias("col"), "gid"))
    full = reduce(DataFrame.unionByName, out)
    n = full.agg(F.count_distinct("row", "col")).first()[0]
    if n != rows * cols or full.count() != n:
        raise ResourceValueError(f"the sites around {target} make no raster of {rows} by {cols}")
    return full


def _steps(sites: DataFrame, target: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest site, step east, step north) from the nine sites around a target."""
    d = planar(F.col("latitude"), F.col("longitude"), F.lit(float(target[0])), F.lit(float(target[1])))
    nine = np.array([(r.latitude, r.longitude) for r in sites.orderBy(d, "gid").select("latitude", "longitude").limit(9).collect()], float)
    if len(nine) < 3:
        raise ResourceValueError("a raster needs more sites")
    origin, moves = nine[0], nine[1:] - nine[0]
    if np.hypot(*(origin - np.asarray(target))) > 2 * np.hypot(*moves[0]):
        raise ResourceValueError(f"{target} is outside the sites")
    angle = np.degrees(np.arctan2(moves[:, 0], moves[:, 1]))
    length = np.hypot(moves[:, 0], moves[:, 1])

    def step(towards: float) -> np.ndarray:
        turn = np.abs((angle - towards + 180) % 360 - 180)
        back = np.abs((angle - towards) % 360 - 180)
        best = min(range(len(moves)), key=lambda i: (round(min(turn[i], back[i]) / 30), length[i]))
        return moves[best] if turn[best] <= back[best] else -moves[best]

    return origin, step(0.0), step(90.0)
