"""Embedding near-duplicates by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits its vectors at the median
of a random projection, and vectors near the border go down both sides.  Every
row then falls through all trees; rows of one label that meet in a leaf are
compared in double precision.  The union over the trees misses a pair only if
each of them parts it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, in_blocks
from .storage import stored

TREES = 8
#: Most vectors the trees are fitted on, those with the smallest hash of their id.
SAMPLE = 20_000
LEAF = 48
#: Half the width of the zone around a split that goes both ways, for unit vectors.
SPILL = 0.03


class Forest:
    """nodes: for each tree its splits in heap order, as directions and borders; all trees have one depth."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] if sample.size else 1
        self.depth, self.spill = depth, spill
        self.directions, self.borders = [], []
        for _ in range(trees):
            directions = rng.standard_normal((max((1 << depth) - 1, 1), width))
            directions /= np.linalg.norm(directions, axis=1, keepdims=True)
            borders = np.zeros(len(directions))
            members = {0: np.arange(len(sample))}
            for node in range((1 << depth) - 1):
                at = members.pop(node)
                along = sample[at] @ directions[node] if len(at) else np.zeros(0)
                borders[node] = np.median(along) if len(at) else 0.0
                members[2 * node + 1], members[2 * node + 2] = at[along < borders[node] + spill], at[along >= borders[node] - spill]
            self.directions.append(directions)
            self.borders.append(borders)

    def leaves(self, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(tree, leaf, rows) for all leaves that rows reach."""
        for tree, (directions, borders) in enumerate(zip(self.directions, self.borders, strict=True)):
            members = {0: np.arange(len(vectors))}
            for node in range((1 << self.depth) - 1):
                at = members.pop(node, None)
                if at is None or not len(at):
                    continue
                along = vectors[at] @ directions[node]
                members[2 * node + 1], members[2 * node + 2] = at[along < borders[node] + self.spill], at[along >= borders[node] - self.spill]
            for leaf, at in members.items():
                if len(at):
                    yield tree, leaf, at


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as unit rows of doubles; shorter ones are filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    # by the largest component first, so that squares of very large or small ones stay finite
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _route(shared, width: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), width)
            found = list(forest.leaves(vectors))
            rows = np.concatenate([at for _, _, at in found])
            tree = np.repeat([t for t, _, _ in found], [len(at) for _, _, at in found])
            leaf = np.repeat([n for _, n, _ in found], [len(at) for _, _, at in found])
            took = batch.take(pa.array(rows))
            yield pa.record_batch([*took.columns, pa.array(tree.astype(np.int32)), pa.array(leaf.astype(np.int64))], ["label", "w", "id", "v", "tree", "leaf"])

    return route


def _compare(least: float):
    def compare(table: pa.Table) -> pa.Table:
        ids, part = table["id"].to_numpy(), table["part"].to_numpy()
        vectors = _matrix(table["v"].combine_chunks(), table["w"][0].as_py())
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        a, b = np.nonzero(vectors[left] @ vectors[right].T >= least)
        a, b = ids[left[a]], ids[right[b]]
        if lo == hi:
            a, b = a[a < b], b[a < b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return compare


def near_vectors(
    vectors: DataFrame, identity: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = 0
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero or not finite, and vectors without label or id
    have no links and are kept; vectors of different widths do not link.  Equal
    vectors of a label are one class: they link with each other and share all links,
    and only one of them is compared.  An empty table has no rows.
    """
    spark = vectors.sparkSession
    kind = "double" if vectors.schema[embedding].dataType.elementType.typeName() != "float" else "float"
    rows = vectors.select(F.col(identity).alias("id"), F.col(label).alias("label"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    # equal vectors have one representative, and rows of its id count once
    classes = good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"))
    classes = stored(classes, "vectors")
    sizes = classes.groupBy("label", F.size("v").alias("w")).count().agg(F.max("count").alias("largest"), F.max("w").alias("width")).first()
    largest, width = sizes.largest or 0, max(sizes.width or 0, 1)
    depth = max(0, math.ceil(math.log2(max(largest, 1) / leaf)))
    taken = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].combine_chunks() if largest else None
    forest = Forest(_matrix(taken, width) if largest else np.zeros((0, width)), depth, trees, spill, seed)
    schema = f"label {rows.schema['label'].dataType.simpleString()}, w int, id long, v array<{kind}>, tree int, leaf long"
    routed = classes.select("label", F.size("v").alias("w"), F.col("id").cast("long"), "v").mapInArrow(_route(spark.sparkContext.broadcast(forest), width), schema)
    blocks = in_blocks(stored(routed, "routed"), ["label", "w", "tree", "leaf"], "id", 256)
    links = stored(blocks.groupBy("label", "w", "tree", "leaf", "lo", "hi").applyInArrow(_compare(least), "a long, b long").distinct(), "pairs")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("id").alias("b"), "copies")
    linked = ends.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    components = connected_components(links)
    known = classes.select("label", "v", F.col("id").alias("rep"), "copies").join(linked, F.col("rep") == F.col("a"), "left").join(components, F.col("rep") == F.col("node"), "left")
    member = good.select(F.col("id"), "label", "v").distinct().join(known, ["label", "v"])
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    member = member.groupBy("id").agg(F.max(n_links).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("id").join(member, "id", "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "id")})
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", identity)
