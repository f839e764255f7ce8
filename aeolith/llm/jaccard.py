"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles.  Equal sets are one class.  MinHash bands
gather classes that may be similar into clusters; inside a cluster, cut into
blocks of bounded size, signatures are compared a slice at a time and a pair is
dropped once the posterior probability that its similarity reaches the threshold
is below the tolerance.  What remains is verified on the whole sets.  Blocks
report counts and spanning links, so no list of all pairs is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, in_blocks, sieve
from .storage import stored
from .tokens import Slab, chain, mix, slabs

WORDS = 5
THRESHOLD = 0.8
#: Bands of so many rows: a pair at the threshold shares none with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
SLICE = 32
TOLERANCE = 1e-6
#: Documents of a block, on each side.
BLOCK = 256
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(slab: Slab, words: int = WORDS) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``words`` words; a shorter text is one shingle."""
    hashes, at = slab.windows(words)
    first = np.searchsorted(at, slab.first)
    out = []
    for r in range(len(slab)):
        n = slab.first[r + 1] - slab.first[r]
        if 0 < n < words:
            out.append(chain(list(slab.hash[slab.first[r] : slab.first[r + 1], None])))
        else:
            out.append(np.unique(hashes[first[r] : first[r + 1]]))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return chain([np.arange(BANDS, dtype=np.uint64), *bands.T])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared hashes the fewest matches a pair may have.

    With a uniform prior, m matches of n leave P(similarity >= t) = P(Bin(n + 1, t) <= m).
    """
    out = {}
    for n in range(SLICE, HASHES + 1, SLICE):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2, size, bands = [], [], [], []
        for _, slab in slabs(batch.column("text")):
            for s in shingle_sets(slab):
                size.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mix(s * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_hashes(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64))
        yield pa.record_batch([batch.column("id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "h1", "h2", "size", "bands"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    # many pairs: products of incidence matrices, over slices of the shingles that occur on both sides
    used_a, used_b = np.unique(i), np.unique(j)
    flat = [np.concatenate([s[x] for x in used]) for s, used in ((a, used_a), (b, used_b))]
    rows = [np.repeat(np.arange(len(used)), [len(s[x]) for x in used]) for s, used in ((a, used_a), (b, used_b))]
    common = np.intersect1d(*[np.unique(f) for f in flat], assume_unique=True)
    place = [np.searchsorted(common, f) for f in flat]
    held = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    total = np.zeros((len(used_a), len(used_b)), np.float32)
    for at in range(0, len(common), 8192):
        sides = []
        for p, r, h, used in zip(place, rows, held, (used_a, used_b), strict=True):
            m = h & (p >= at) & (p < at + 8192)
            side = np.zeros((len(used), min(8192, len(common) - at)), np.float32)
            side[r[m], p[m] - at] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total[np.searchsorted(used_a, i), np.searchsorted(used_b, j)].astype(np.int64)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of sets, i < j inside one list, that reach the threshold."""
    other = left if right is None else right
    signs = [np.array([signature(s) for s in sets]).reshape(-1, HASHES) for sets in (left, *([] if right is None else [right]))]
    sizes = [np.array([len(s) for s in sets]) for sets in (left, other)]
    near = np.minimum(sizes[0][:, None], sizes[1]) >= threshold * np.maximum(sizes[0][:, None], sizes[1])
    i, j = np.nonzero(np.triu(near, 1) if right is None else near)
    matches = np.zeros(len(i), np.int64)
    for n in range(SLICE, HASHES + 1, SLICE):
        part = slice(n - SLICE, n)
        matches += (signs[0][i, part] == signs[-1][j, part]).sum(1)
        keep = matches >= least[n]
        i, j, matches = i[keep], j[keep], matches[keep]
    common = _overlaps(left, other, i, j)
    union = sizes[0][i] + sizes[1][j] - common
    keep = common >= threshold * union - 1e-9
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float, least: dict[int, int]):
    def verify(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")]).combine_chunks()
        sets = [s for _, slab in slabs(table["text"].combine_chunks()) for s in shingle_sets(slab)]
        cluster, node, part, copies = (table[c].to_numpy() for c in ("cluster", "node", "part", "copies"))
        cuts = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1, append=cluster[-1] + 1))
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = table["lo"][begin].as_py(), table["hi"][begin].as_py()
            at = np.arange(begin, end)
            left, right = at[part[begin:end] == lo], at[part[begin:end] == hi]
            i, j = linked_pairs([sets[x] for x in left], None if lo == hi else [sets[x] for x in right], threshold, least)
            a, b = left[i] - begin, right[j] - begin
            # rows that share an id are one document
            pairs = np.unique(np.stack([node[begin + np.minimum(a, b)], node[begin + np.maximum(a, b)]], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if not len(pairs):
                continue
            nodes, inverse = np.unique(pairs, return_inverse=True)
            inverse = inverse.reshape(-1, 2)
            size = np.zeros(len(nodes), np.int64)
            size[np.searchsorted(nodes, node[begin:end][np.isin(node[begin:end], nodes)])] = copies[begin:end][np.isin(node[begin:end], nodes)]
            others = np.bincount(inverse[:, 0], size[inverse[:, 1]], minlength=len(nodes)) + np.bincount(inverse[:, 1], size[inverse[:, 0]], minlength=len(nodes))
            out += zip(nodes.tolist(), others.astype(np.int64).tolist(), nodes[_roots(len(nodes), inverse[:, 0], inverse[:, 1])].tolist(), strict=True)
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "others", "hub"), columns, strict=True)})

    return verify


def near_documents(docs: DataFrame, text: str = "text", identity: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(id, class_id, class_size, n_links, component_id, kept) for each row.

    Documents with equal sets are a class, named by its smallest id.  ``n_links``
    counts the other documents of similarity ``threshold`` or more, copies
    included; ``component_id`` is the smallest id reachable by links; of each group
    the document of that id is kept.  Texts without words, and rows without id,
    have no links and are kept.  Rows that share an id are one document.
    """
    rows = docs.select(F.col(identity).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = stored(rows.mapInArrow(_describe, "id long, h1 long, h2 long, size long, bands array<long>"), "described")
    worded = described.where("size > 0 AND id IS NOT NULL")
    classes = stored(worded.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count_distinct("id").alias("copies")), "classes")
    bands = worded.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).where("id = node").select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("band", "hub")
    buckets = stored(buckets, "buckets")
    # most bands stand alone: they, and below the texts outside all clusters, never reach a shuffle
    shared = sieve(buckets, "band", bands, F.col("band")).join(buckets.hint("merge"), "band")
    clusters = connected_components(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    copies = classes.groupBy("node").agg(F.max("copies").alias("copies"))
    members = stored(clusters.select("node", F.col("component").alias("cluster")).join(copies, "node"), "members")
    many = members.count()
    cut = in_blocks(members, ["cluster"], "node", block)
    # small clusters share tasks
    bins = F.when(F.col("hi") > 0, F.xxhash64("cluster", "lo", "hi")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(max(1, many // (2 * block)))))
    wanted = sieve(members, "node", rows.where("id IS NOT NULL"), F.col("id")).hint("merge")
    texts = cut.join(wanted, cut.node == wanted.id).select("cluster", "node", "part", "copies", "lo", "hi", "text", bins.alias("bin"))
    found = texts.groupBy("bin", "lo", "hi").applyInArrow(_verify(threshold, least_matches(threshold, tolerance)), "node long, others long, hub long")
    found = stored(found, "links")
    linked = found.groupBy("node").agg(F.sum("others").alias("others"))
    components = connected_components(found.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    known = classes.join(linked, "node", "left").join(components, "node", "left")
    out = described.select("id", "h1", "h2", "size").join(known, ["h1", "h2"], "left")
    alone = F.col("size").eqNullSafe(0) | F.col("id").isNull()
    out = out.select(
        F.col("id").alias(identity),
        F.when(alone, F.col("id")).otherwise(F.col("node")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("class_size"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.coalesce("component", "node")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(identity) == F.col("component_id"), F.lit(True)))
