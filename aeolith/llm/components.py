"""Connected components and blocks of bounded size, by DataFrame operations alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored


#: A bitmap has four bits a key, or up to eight, within these bounds; the larger is 4 MB.
_LEAST_BITS, _MOST_BITS = 16, 25
#: Keys of more rows than this, at most so many of them, are dealt over so many tasks by lookup().
_HOT_ROWS, _HOT_KEYS, _SALTS = 1000, 1000, 32


def _sieved(wanted: DataFrame, key: str, frame: DataFrame, by: Column) -> tuple[DataFrame, Column]:
    bits = min(_MOST_BITS, max(_LEAST_BITS, (4 * wanted.count()).bit_length()))
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = wanted.select(bucket.alias("b")).selectExpr("CAST(shiftright(b, 6) AS int) AS word", "shiftleft(1L, CAST(b & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()  # at most 2 ** (_MOST_BITS - 6) rows
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[table["word"].to_numpy()] = table["bits"].to_numpy()
    schema = pa.schema([("bits", pa.list_(pa.int64()))])
    packed = frame.sparkSession.createDataFrame(pa.table([pa.array([filled])], schema=schema))
    marked = frame.withColumn("__at", F.pmod(F.xxhash64(by), F.lit(1 << bits)))
    word = F.get(packed.scalar(), F.expr("CAST(shiftright(__at, 6) AS int)"))
    return marked, word.bitwiseAND(F.expr("shiftleft(1L, CAST(__at & 63 AS int))")) != 0


def sieve(wanted: DataFrame, key: str, frame: DataFrame, by: Column) -> DataFrame:
    """frame without most rows whose ``by`` is no wanted key.

    A bitmap of bounded size (4 MB at most) is filled by an aggregate and read as one
    constant, so rows that no join needs are dropped before its shuffle.
    """
    marked, there = _sieved(wanted, key, frame, by)
    return marked.where(there).drop("__at")


def parted(wanted: DataFrame, key: str, frame: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a wanted key, rows that have none), by the same bitmap."""
    marked, there = _sieved(wanted, key, frame, by)
    return marked.where(there).drop("__at"), marked.where(~there).drop("__at")


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """(__hot) the keys that most rows share; few enough to broadcast at any size."""
    return hottest(rows.groupBy(key).agg(F.count("*").alias("n")), key)


def hottest(counts: DataFrame, key: str) -> DataFrame:
    """(__hot) the keys of most rows from a table of keys and their numbers ``n``."""
    counted = counts.select(F.col(key).alias("__hot"), "n").where(F.col("n") > _HOT_ROWS)
    return counted.orderBy(F.desc("n")).limit(_HOT_KEYS).select("__hot")


def _dealt(rows: DataFrame, key: str, hot: DataFrame, salts: Column) -> DataFrame:
    return rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), salts)).drop("__hot")


def _spread(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows with a ``__salt`` that deals the rows of hot keys."""
    return _dealt(rows, key, hot, F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS))).fillna({"__salt": 0})


def _copied(table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """table with its rows of hot keys once for each salt."""
    salts = _dealt(table, key, hot, F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>"))
    return salts.withColumn("__salt", F.explode(F.coalesce("__salt", F.array(F.lit(0).cast("long")))))


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with the row of table, which holds each key once, so that no task gets all rows of a hot key.

    ``hot``, as hottest() gives it, saves counting the rows of each key.
    """
    hot = _hot(rows, key) if hot is None else hot
    return _spread(rows, key, hot).join(_copied(table, key, hot), [key, "__salt"], how).drop("__salt")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); a component is named by its smallest node.

    First every node hands its smaller neighbours over to the smallest of them,
    which leaves few links of groups that many buckets found.  Then each round takes the smallest label among a node and its neighbours, then the
    label of that label, so chains halve.  Rounds are written to the shared folder,
    which cuts lineage.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    lowest = links.groupBy("b").agg(F.min("a").alias("m"))
    handed = links.join(lowest, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    links = lowest.select(F.col("m").alias("a"), "b").unionByName(handed).distinct()
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    # nodes of many links, the same in all rounds
    hot = stored(_hot(both, "b"), "hubs")
    spread = _spread(both, "b", hot)
    while True:
        near = spread.join(_copied(labels.withColumnRenamed("node", "b"), "b", hot), ["b", "__salt"]).groupBy("a").agg(F.min("component").alias("m"))
        better = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        better = stored(better, "better")
        parent = labels.select(F.col("node").alias("component"), F.col("component").alias("of_parent"))
        jumped = lookup(better, "component", parent).select("node", "old", F.least("component", "of_parent").alias("component"))
        following = stored(jumped, "labels")
        changed = following.where("component <> old").limit(1).count()
        drop(labels)
        drop(better)
        path = following._stored_path
        labels = following.select("node", "component")
        labels._stored_path = path
        if not changed:
            drop(both)
            drop(hot)
            return labels


def in_blocks(members: DataFrame, keys: list[str], member: str, limit: int, weight: str | None = None) -> DataFrame:
    """members with ``lo``, ``hi`` and ``part``: groups of the keys, cut so that each (keys, lo, hi) is small.

    A group of more than ``limit`` (members, or their weight) is dealt by hash into
    parts of about that size; each pair of parts is a block, so any two members of
    a group meet in one block: in (p, p) if both are in part p.
    """
    size = F.sum(weight) if weight else F.count("*")
    large = members.groupBy(*keys).agg(F.ceil(size / F.lit(limit)).cast("int").alias("parts")).where("parts > 1")
    out = members.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "parts")
