"""Benchmark decontamination by a prefix-filtered set join.

An item is a sequence of words; its windows are its runs of ``width`` words (a
shorter item is one window).  A document contains a window only if it holds the
window's rarest word, so that word alone is the necessary prefix at containment
1.  One pass over all documents counts how often each benchmark word occurs; a
second joins document words with those prefixes, drops candidates that by
position cannot fit into the document, compares the rest hash by hash and at
last byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .tokens import Sieve, Slab, slabs

#: Most bytes of benchmark text that one pass indexes; a larger benchmark takes several passes.
BLOCK_BYTES = 2 << 20
_PAIRS = 1 << 18


class WindowIndex:
    """The distinct windows of a block of items, found by their rarest word."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        windows: dict[bytes, int] = {}
        owners: list[set[str]] = []
        hashes: list[np.ndarray] = []
        for item_id, text in items:
            for _, slab in slabs(pa.array([text], pa.string())):
                n = len(slab.hash)
                for i in range(max(1, n - width + 1) if n else 0):
                    size = min(width, n)
                    key = b" ".join(slab.word(i + j) for j in range(size))
                    at = windows.setdefault(key, len(windows))
                    if at == len(owners):
                        owners.append(set())
                        hashes.append(slab.hash[i : i + size])
                    if item_id is not None:
                        owners[at].add(item_id)
        self.texts, self.owners = list(windows), owners
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.words = np.zeros((len(hashes), width), np.uint64)
        for i, h in enumerate(hashes):
            self.words[i, : len(h)] = h
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        """Chooses each window's prefix: its word with the smallest count, the earliest of equals."""
        often = np.array([counts.get(int(h), 0) for h in self.vocabulary], np.int64)
        rank = often[np.searchsorted(self.vocabulary, np.where(self.words, self.words, self.vocabulary[:1]))] if len(self.size) else np.zeros((0, 1))
        used = np.arange(self.words.shape[1])[None, :] < self.size[:, None]
        offset = np.where(used, rank, np.iinfo(np.int64).max).argmin(1) if len(self.size) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(self.size)), offset]
        order = np.argsort(prefix, kind="stable")
        self.sieve = Sieve(prefix)
        self.listed, self.offset = order, offset
        self.begin = np.searchsorted(prefix[order], self.sieve.keys)
        self.count = np.diff(np.append(self.begin, len(order)))

    def occurrences(self, slab: Slab) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, window) of all occurrences in a slab."""
        place, key = self.sieve.hits(slab.hash)
        row_end = np.repeat(slab.first[1:], np.diff(slab.first))
        row_start = np.repeat(slab.first[:-1], np.diff(slab.first))
        ahead = np.append(0, np.cumsum(self.count[key]))
        i = 0
        while i < len(place):
            j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + _PAIRS, "right")) - 1)
            each = self.count[key[i:j]]
            at = np.repeat(place[i:j], each)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            window = self.listed[np.repeat(self.begin[key[i:j]], each) + nth]
            first = at - self.offset[window]
            keep = (first >= row_start[at]) & (first + self.size[window] <= row_end[at])
            first, window = first[keep], window[keep]
            for step in range(self.words.shape[1]):
                there = np.minimum(first + step, len(slab.hash) - 1)
                keep = (step >= self.size[window]) | (slab.hash[there] == self.words[window, step])
                first, window = first[keep], window[keep]
            exact = [b" ".join(slab.word(f + k) for k in range(self.size[w])) == self.texts[w] for f, w in zip(first, window, strict=True)]
            yield first[exact], window[exact]
            i = j


def _count_words(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, total = Sieve(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, slab in slabs(batch.column(0)):
                total += np.bincount(sieve.hits(slab.hash)[1], minlength=len(total))
        yield pa.record_batch([pa.array(sieve.keys.view(np.int64)), pa.array(total)], ["word", "n"])

    return count


def _mark(shared):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: WindowIndex = shared.value
        for batch in batches:
            had_spans, had_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for rows, slab in slabs(batch.column("text")):
                edges = np.zeros(len(slab.hash) + 1, np.int64)
                row_of = slab.row()
                found: dict[int, set[str]] = {}
                for r in range(len(slab)):
                    for s, e in zip(had_spans[rows.start + r][::2], had_spans[rows.start + r][1::2], strict=True):
                        edges[slab.first[r] + s] += 1
                        edges[slab.first[r] + e] -= 1
                for first, window in index.occurrences(slab):
                    np.add.at(edges, first, 1)
                    np.add.at(edges, first + index.size[window], -1)
                    for r, w in set(zip(row_of[first].tolist(), window.tolist(), strict=True)):
                        found.setdefault(r, set()).update(index.owners[w])
                hit = np.cumsum(edges[:-1]) > 0
                n_words += np.diff(slab.first).tolist()
                for r in range(len(slab)):
                    own = hit[slab.first[r] : slab.first[r + 1]]
                    spans.append(np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8))).tolist() if own.any() else [])
                    items.append(sorted({*had_items[rows.start + r], *found.get(r, ())}))
            yield pa.record_batch(
                [batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["row", "text", "n_words", "spans", "items"],
            )

    return mark


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """The columns ``keep`` of each document with n_words, n_hit, spans and items.

    ``spans`` lists the hit words as start, end, start, end, ... (ends exclusive),
    ``items`` the ids, as sorted strings, of the items of which a window occurs.
    Null and empty texts have no words; items without words are no item; an item
    without an id marks words but is not listed; repeated rows are judged alike.
    An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")).where(F.col("body").isNotNull())
    size = listed.agg(F.coalesce(F.sum(F.octet_length("body") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))
    rest = [F.col(c) for c in keep if c != text] or [F.lit(0).alias("none")]
    out = docs.select(F.struct(*rest).alias("row"), F.col(text).alias("text")).selectExpr("row", "text", "0L AS n_words", "CAST(array() AS array<bigint>) AS spans", "CAST(array() AS array<string>) AS items")
    texts = docs.select(F.col(text).alias("text"))
    for number in range(blocks):
        index = WindowIndex([tuple(r) for r in listed.where(block == number).collect()], width)  # a block is bounded by BLOCK_BYTES
        counts = texts.mapInArrow(_count_words(index.vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        index.order_by_rarity({r.word % (1 << 64): r.n for r in counts})
        out = out.mapInArrow(_mark(spark.sparkContext.broadcast(index)), out.schema)
        if number + 1 < blocks:
            out = stored(out, "contamination")
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    kept = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in keep]
    return out.select(*kept, "n_words", hit.alias("n_hit"), "spans", "items")


def is_contaminated(one_in: int = 20):
    """Hit words are at least one in ``one_in``."""
    return (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))
