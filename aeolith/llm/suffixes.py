"""Removal of repeated substrings by sorting the suffixes that can repeat.

Of each window of ``length`` bytes the least hash among its grams, of a third of that
length, is its anchor: equal windows have it at the same place, so only anchors whose
gram is read twice can lie in a repeated window.  The bytes around such an anchor, as
far as its windows reach, are its context.

1. Equal texts are one, that of the smallest id; texts are dealt into blocks by digest.
2. Grams of anchors are counted over blocks; a block learns which of its own occur twice.
3. Equal contexts are found by digest: all but the first are covered whole.
4. Where a gram has several contexts, their suffixes from the gram on, and the reversed
   prefixes before it, are sorted: multikey quicksort to a shallow depth, then blind
   tries for the groups that share more.  Neighbours' common lengths give the classes
   of equal windows at each place; all but the first of a class are covered.
5. A gram of too many contexts for one task is split into the left and the right half
   of its windows, whose longer common core parts them further; parts of equal bytes
   are one again, so only contexts that differ inside a half go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stored
from .tokens import _power, mix, string_buffers

LENGTH = 100
#: Bytes of texts in a block; a longer text is larger than that alone.
BLOCK_BYTES = 4 << 20
#: Contexts of one gram that one task may sort, and contexts of many grams that it sorts together.
GROUP_CONTEXTS, SHARD_CONTEXTS = 1024, 16_384
#: Bytes that quicksort compares before blind tries take over; a multiple of 8.
SHALLOW = 16
_STEP = 1 << 18
_PLACE_BITS = np.uint64(20)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTE = np.random.default_rng(1998).integers(1, 2**63, 256, dtype=np.uint64)
_LAST = 2**63 - 1

_ITEM = "block int, row int, id long, tie long, start long, stop long, left int, gram long, h1 long, h2 long"
_COVER = "block int, row int, start long, stop long"


class Shape(NamedTuple):
    """Of windows: their length, that of their grams, and how far they reach beyond a gram."""

    length: int
    gram: int
    reach: int

    @classmethod
    def of(cls, length: int) -> Shape:
        gram = max(1, length // 3)
        return cls(length, gram, length - gram)


# --- sorting ---------------------------------------------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows of ``words`` ordered by group and words; starts marks the first of rows that are equal in both.

    Parts of all groups are split at once: a pivot word for each, into rows below, at and
    above it; those at the pivot go on with the next word.
    """
    order = np.argsort(group, kind="stable")
    m, most = words.shape
    starts = np.ones(m, bool)
    starts[1:] = group[order][1:] != group[order][:-1]
    depth = np.zeros(m, np.int64)
    while True:
        part = np.cumsum(starts) - 1
        size = np.bincount(part, minlength=1)
        active = np.flatnonzero((size[part] > 1) & (depth < most))
        if not len(active):
            return order, starts
        first = np.flatnonzero(starts)
        middle = (first + size // 2)[part[active]]
        value, pivot = words[order[active], depth[active]], words[order[middle], depth[middle]]
        side = (value > pivot).astype(np.int64) - (value < pivot) + 1
        split = part[active] * 3 + side
        by = np.argsort(split, kind="stable")
        order[active], split = order[active[by]], split[by]
        depth[active] += split % 3 == 1
        starts[active[1:]] |= split[1:] != split[:-1]


class BlindTrie:
    """A trie of branching places only.  Going down compares one byte a branch; one string at the end tells how much was right."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | list[int] | None = None
        self.strings: dict[int, bytes] = {}

    def insert(self, row: int, string: bytes) -> None:
        self.strings[row] = string
        if self.root is None:
            self.root = [row]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        known = self.strings[node[0]]
        if known == string:
            node.append(row)
            return
        same = _common(known, string)
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            above, node = (node, string[node[0]]), node[1][string[node[0]]]
        if isinstance(node, tuple) and node[0] == same:
            node[1][string[same]] = [row]
            return
        branch = (same, {known[same]: node, string[same]: [row]})
        if above:
            above[0][1][above[1]] = branch
        else:
            self.root = branch

    def ordered(self) -> list[int]:
        out, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            if isinstance(node, tuple):
                open_ += [child for _, child in sorted(node[1].items(), reverse=True)]
            else:
                out += node
        return out


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix of two different strings of one length."""
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def deep_shallow_sort(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of bytes ordered inside their groups, and the common length of each with the row before it (-1: another group)."""
    m, width = strings.shape
    shallow = np.zeros((m, SHALLOW), np.uint8)
    shallow[:, : min(SHALLOW, width)] = strings[:, :SHALLOW]
    order, starts = multikey_quicksort(shallow.view(">u8").astype(np.uint64), group)
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, m))
    for s, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        trie = BlindTrie()
        for row in order[s : s + n].tolist():
            trie.insert(row, strings[row, SHALLOW:].tobytes())
        order[s : s + n] = trie.ordered()
    common = np.full(m, -1)
    if m > 1:
        differs = np.ones((m - 1, width + 1), bool)
        np.not_equal(strings[order[1:]], strings[order[:-1]], out=differs[:, :width])
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], differs.argmax(1), -1)
    return order, common


# --- blocks of texts -------------------------------------------------------------------------------------------------


class Block:
    """The texts of a block in the order of their ids, and its anchors."""

    def __init__(self, table: pa.Table):
        by = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("tie", "ascending")])
        self.table = table.take(by).combine_chunks()
        self.ids, self.ties = (self.table[c].to_numpy() for c in ("id", "tie"))
        self.data, self.bounds = string_buffers(_as_string(self.table["data"].combine_chunks()))

    def anchors(self, shape: Shape) -> dict[str, np.ndarray]:
        """For each anchor: ``at`` its place in the block, ``gram`` a hash, ``row`` its text, ``start`` and ``stop`` its context in the block, two hashes of that."""
        n, parts = len(self.data), []
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        for c in range(0, max(0, n - shape.length + 1), _STEP):
            low, high = max(0, c - shape.reach), min(n, c + _STEP + shape.reach + shape.length)
            piece = self.data[low:high]
            sums = [_prefix_sums(piece, base) for base in _BASES]
            last = min(c + _STEP, n - shape.length + 1)
            grams = _hashes(sums[0], np.arange(c - low, last - low + shape.reach), shape.gram, _BASES[0])
            packed = (grams * np.uint64(_BASES[1])) >> _PLACE_BITS << _PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
            least = _sliding_min(packed, shape.reach + 1)[: last - c]
            place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)[np.arange(c, last) + shape.length <= ends[c:last]]
            place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
            at = place + c
            row = np.searchsorted(self.bounds, at, "right") - 1
            start, stop = np.maximum(self.bounds[row], at - shape.reach), np.minimum(self.bounds[row + 1], at + shape.length)
            around = [_hashes(s, start - low, stop - start, b) for s, b in zip(sums, _BASES, strict=True)]
            parts.append({"at": at, "gram": grams[place].view(np.int64), "row": row, "start": start, "stop": stop, "h1": around[0].view(np.int64), "h2": around[1].view(np.int64)})
        if not parts:
            return {k: np.zeros(0, np.int64) for k in ("at", "gram", "row", "start", "stop", "h1", "h2")}
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        _, once = np.unique(whole["at"], return_index=True)
        return {k: v[once] for k, v in whole.items()}


def _as_string(column: pa.Array) -> pa.Array:
    """The same buffers seen as a string column, whatever bytes they hold."""
    large = column.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(large), large.buffers(), large.null_count, large.offset)


def _prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(base, len(data)), out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, size: np.ndarray | int, base: int) -> np.ndarray:
    """Hashes of the bytes from each start, the same wherever they stand."""
    back = _power(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[start + size] - sums[start]) * back[start] + np.asarray(size).astype(np.uint64))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _table(schema: str, **columns: object) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    n = max((len(columns[name]) for name, _ in fields if not np.isscalar(columns[name])), default=0)
    return pa.table({name: columns[name] if isinstance(columns[name], pa.Array) else pa.array(np.full(n, columns[name]) if np.isscalar(columns[name]) else columns[name], kinds[kind]) for name, kind in fields})


_GRAM = "gram long, block int, again boolean"


def _grams(shape: Shape) -> Callable[[pa.Table], pa.Table]:
    def grams(table: pa.Table) -> pa.Table:
        keys, n = np.unique(Block(table).anchors(shape)["gram"], return_counts=True)
        return _table(_GRAM, gram=keys, block=table["block"][0].as_py(), again=n > 1)

    return grams


def _union(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of rows, united where they touch."""
    if not len(row):
        return row, start, stop
    by = np.lexsort((start, row))
    row, start, stop = row[by], start[by], stop[by]
    shift = (row - row[0]) * (stop.max() + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(row), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    cut = np.flatnonzero(new)
    return row[cut], start[cut], (reach - shift)[np.append(cut[1:], len(row)) - 1]


def _contexts(shape: Shape) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block: one row for each context of a gram that occurs twice, its first; and, without a gram, what later ones cover."""

    def contexts(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not texts.num_rows or not shared.num_rows:
            return _table(_ITEM, **dict.fromkeys("block row id tie start stop left gram h1 h2".split(), np.zeros(0, np.int64)))
        block = Block(texts)
        a = block.anchors(shape)
        keys = np.sort(shared["gram"].to_numpy())
        there = keys[np.minimum(np.searchsorted(keys, a["gram"]), len(keys) - 1)] == a["gram"]
        a = {k: v[there] for k, v in a.items()}
        left = a["at"] - a["start"]
        # places rise, so the first of equal contexts is the first in the order of ids
        by = np.lexsort((a["at"], left, a["stop"] - a["start"], a["h2"], a["h1"], a["gram"]))
        same = np.ones(max(len(by) - 1, 0), bool)
        for v in (a["gram"], a["h1"], a["h2"], left, a["stop"] - a["start"]):
            same &= v[by][1:] == v[by][:-1]
        first = np.ones(len(by), bool)
        first[by[1:]] = ~same
        home = block.bounds[a["row"]]
        row, start, stop = _union(a["row"][~first], (a["start"] - home)[~first], (a["stop"] - home)[~first])
        a, left, home = {k: v[first] for k, v in a.items()}, left[first], home[first]
        none = np.zeros(len(row), bool)

        def with_gram(values: np.ndarray) -> pa.Array:
            return pa.array(np.append(values, none.astype(np.int64)), mask=np.append(np.zeros(len(left), bool), ~none))

        rows = np.append(a["row"], row)
        number = texts["block"][0].as_py()
        return _table(
            _ITEM, block=number, row=rows, id=block.ids[rows], tie=block.ties[rows], start=np.append(a["start"] - home, start), stop=np.append(a["stop"] - home, stop), left=np.append(left, none), gram=with_gram(a["gram"]), h1=with_gram(a["h1"]), h2=with_gram(a["h2"])
        )

    return contexts


_OPEN = "core1 long, core2 long, low int, high int, block int, row int, id long, tie long, start long, left int, bytes binary, m long"


def _fetch(shape: Shape) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The bytes of the contexts that a block is asked for."""

    def fetch(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        w = {c: wanted[c].to_numpy() for c in ("row", "id", "tie", "start", "stop", "left", "gram", "m")}
        block = Block(texts) if texts.num_rows else None
        home = block.bounds[w["row"]] if block is not None else np.zeros(0, np.int64)
        size = w["stop"] - w["start"]
        offsets = np.append(0, np.cumsum(size))
        places = np.repeat(home + w["start"] - offsets[:-1], size) + np.arange(offsets[-1])
        data = block.data[places] if block is not None else np.zeros(0, np.uint8)
        around = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])
        number = texts["block"][0].as_py() if texts.num_rows else 0
        return _table(_OPEN, core1=w["gram"], core2=np.zeros(len(size), np.int64), low=np.zeros(len(size), np.int64), high=np.full(len(size), shape.reach), block=number, row=w["row"], id=w["id"], tie=w["tie"], start=w["start"], left=w["left"], bytes=around, m=w["m"])

    return fetch


def _sorted_shard(shape: Shape) -> Callable[[pa.Table], pa.Table]:
    """What the contexts of a shard cover: for each the first and last of its windows that an earlier context of its core has as well."""

    def covers(table: pa.Table) -> pa.Table:
        at = pc.add(table["start"], table["left"].cast(pa.int64()))
        table = table.append_column("at", at)
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("id", "tie", "at")])).combine_chunks()
        core1, core2, low, high, left, start = (table[c].to_numpy().astype(np.int64) for c in ("core1", "core2", "low", "high", "left", "start"))
        _, group = np.unique(np.stack([core1, core2, low, high], 1), axis=0, return_inverse=True)
        data, bounds = string_buffers(_as_string(table["bytes"].combine_chunks()))
        m, reach = len(left), shape.reach
        right = np.diff(bounds) - left - shape.gram
        step = np.arange(reach)
        middle = (bounds[:-1] + left)[:, None]
        sides = []
        for places, known in ((middle - 1 - step, left), (middle + shape.gram + step, right)):
            strings = np.where(step < known[:, None], data[np.clip(places, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)
            order, common = deep_shallow_sort(strings, group.ravel())
            sides.append((order, common))
        first, last = np.full(m, reach + 1), np.full(m, -1)

        def classes(side: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
            """Rows of one group whose n bytes on a side are equal have one number."""
            out = np.empty(m, np.int64)
            out[side[0]] = np.cumsum(side[1] < n)
            return out

        for d in range(reach + 1):
            rows = np.flatnonzero((left >= d) & (right >= reach - d) & (low <= d) & (d <= high))
            if len(rows) < 2:
                continue
            window = (classes(sides[0], d) * (m + 1) + classes(sides[1], reach - d))[rows]
            by = np.argsort(window, kind="stable")
            later = rows[by[1:][window[by[1:]] == window[by[:-1]]]]
            first[later] = np.minimum(first[later], d)
            last[later] = d
        found = np.flatnonzero(last >= 0)
        at = (start + left)[found]
        return _table(_COVER, block=table["block"].to_numpy()[found], row=table["row"].to_numpy()[found], start=at - last[found], stop=at - first[found] + shape.length)

    return covers


_SPLIT = _OPEN.replace("m long", "own1 long, own2 long")


def _halved(shape: Shape):
    """Each context twice: with the windows of either half of its range, cut to what these reach, under the hash of the bytes they all hold."""

    def halved(batches):
        for batch in batches:
            out = {name.split()[0]: [] for name in _SPLIT.split(", ")}
            for r in batch.to_pylist():
                middle = (r["low"] + r["high"]) // 2
                right = len(r["bytes"]) - r["left"] - shape.gram
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    # of these windows the ones that fit into the text
                    if low > high or max(low, shape.reach - right) > min(high, r["left"]):
                        continue
                    before, after = min(high, r["left"]), min(shape.reach - low, right)
                    around = r["bytes"][r["left"] - before : r["left"] + shape.gram + after]
                    core = around[before - low : before + shape.gram + shape.reach - high]
                    digests = [np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64).tolist() for x in (core, around + before.to_bytes(4))]
                    new = r | {"core1": digests[0][0], "core2": digests[0][1], "own1": digests[1][0], "own2": digests[1][1], "low": low, "high": high, "start": r["start"] + r["left"] - before, "left": before, "bytes": around}
                    for k, v in out.items():
                        v.append(new[k])
            yield from _table(_SPLIT, **{k: pa.array(v, pa.binary()) if k == "bytes" else np.array(v, np.int64) for k, v in out.items()}).to_batches()

    return halved


_CORE = ["core1", "core2", "low", "high"]
_POSITION = ("id", "tie", "start")


def _parted(items: DataFrame, same: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the first of the items that agree on ``same``, what the others cover)."""
    first = items.groupBy(*same).agg(F.min(F.struct(*_POSITION, *carried)).alias("f"))
    place = first.select(*same, F.struct(*[F.col("f")[c].alias(c) for c in _POSITION]).alias("place"))
    others = items.join(place, same).where(F.struct(*_POSITION) != F.col("place"))
    return first.select(*same, "f.*"), others.select("block", "row", "start", (F.col("start") + F.col("size")).alias("stop"))


def _sized(items: DataFrame, core: list[str]) -> DataFrame:
    """The items of cores that have several, with their number ``m``."""
    return items.join(items.groupBy(*core).agg(F.count("*").alias("m")).where("m > 1"), core)


def repeated_ranges(texts: DataFrame, length: int = LENGTH, group: int = GROUP_CONTEXTS) -> DataFrame:
    """(block, row, start, stop): ranges of the distinct texts (block, id, tie, data), whose union are the windows of ``length`` bytes that also start earlier.

    ``row`` is the place of a text in its block, by id and tie.
    """
    shape = Shape.of(length)
    of_gram = Window.partitionBy("gram")
    grams = texts.groupBy("block").applyInArrow(_grams(shape), _GRAM)
    twice = (F.count("*").over(of_gram) > 1) | F.max("again").over(of_gram)
    shared = stored(grams.withColumn("twice", twice).where("twice").select("gram", "block"), "shared")
    found = stored(texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_contexts(shape), _ITEM), "contexts")
    drop(shared)
    covers = [found.where("gram IS NULL").select("block", "row", "start", "stop")]
    items = found.where("gram IS NOT NULL").withColumn("size", F.col("stop") - F.col("start"))
    first, others = _parted(items, ["gram", "h1", "h2", "left", "size"], ["block", "row", "stop"])
    covers.append(stored(others, "covers"))
    asked = stored(_sized(first, ["gram"]), "asked")
    rows = stored(texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_fetch(shape), _OPEN), "open")
    drop(asked)
    while True:
        few = rows.where(F.col("m") <= group)
        total = few.count()
        if total:
            shard = F.pmod(F.xxhash64(*_CORE), F.lit(-(-total // SHARD_CONTEXTS)))
            covers.append(stored(few.drop("m").groupBy(shard.alias("shard")).applyInArrow(_sorted_shard(shape), _COVER), "covers"))
        many = rows.where(F.col("m") > group).drop("m")
        if not many.limit(1).count():
            drop(rows)
            break
        halves = stored(many.mapInArrow(_halved(shape), _SPLIT), "halves").withColumn("size", F.octet_length("bytes"))
        drop(rows)
        first, others = _parted(halves, [*_CORE, "own1", "own2"], ["left", "block", "row", "bytes"])
        covers.append(stored(others, "covers"))
        rows = stored(_sized(first.drop("own1", "own2"), _CORE), "open")
    out = covers[0]
    for part in covers[1:]:
        out = out.unionByName(part)
    return out


_CUT = "digest string, n_removed long, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string, kept binary"


def _cut(content: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The texts of a block that lose bytes, without these."""

    def cut(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        out = {name.split()[0]: [] for name in _CUT.split(", ")}
        if texts.num_rows and ranges.num_rows:
            block = Block(texts)
            row, start, stop = _union(*(ranges[c].to_numpy().astype(np.int64) for c in ("row", "start", "stop")))
            cuts = np.searchsorted(row, np.arange(len(block.ids) + 1))
            digests = block.table["digest"].to_pylist()
            for r in np.unique(row).tolist():
                home, end = block.bounds[r], block.bounds[r + 1]
                s, e = start[cuts[r] : cuts[r + 1]], stop[cuts[r] : cuts[r + 1]]
                kept = b"".join(block.data[a:b].tobytes() for a, b in zip(np.append(home, home + e), np.append(home + s, end), strict=True))
                out["digest"].append(digests[r])
                out["n_removed"].append(int((e - s).sum()))
                out["spans"].append([{"start": a, "stop": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if content else None)
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        kinds = dict(zip(out, (pa.string(), pa.int64(), pa.list_(span), pa.string(), pa.binary()), strict=True))
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return cut


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def dedup_substrings(docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", length: int = LENGTH, content: bool = False, group: int = GROUP_CONTEXTS) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_removed, spans (start, stop in bytes) and kept_sha256, and with ``content`` the bytes ``kept``: a row for each row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    row of smaller id, or before it in its own text.  Null texts are empty; shorter texts
    lose nothing.  Rows of one id and one text are one document and lose the same bytes;
    different texts of one id come in the order of their digests; rows without id come
    last.  An empty table gives no rows.
    """
    own = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    rows = docs.select(F.struct(*keep).alias("__row"), own.alias("__id"), _bytes(text).alias("__data"))
    rows = rows.withColumns({"digest": F.sha2("__data", 256), "n_bytes": F.octet_length("__data").cast("long")})
    texts = stored(rows.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("__id").alias("id"), F.first("__data").alias("data")), "texts")
    total = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    block = F.pmod(F.xxhash64("digest"), F.lit(-(-total // BLOCK_BYTES) or 1)).cast("int")
    dealt = texts.select("digest", "id", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("tie"), "data", block.alias("block"))
    ranges = repeated_ranges(dealt.drop("digest"), length, group)
    lost = stored(dealt.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(_cut(content), _CUT), "cut")
    known = texts.select("digest", F.col("id").alias("__first")).join(lost, "digest", "left")
    out = rows.join(known, "digest", "left") if content else rows.drop("__data").join(known.drop("kept"), "digest", "left")
    copy = F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    values = {
        "n_removed": F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "spans": F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))),
        "kept_sha256": F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "digest")),
    }
    if content:
        values["kept"] = F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "__data"))
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], "n_bytes", *[v.alias(k) for k, v in values.items()])
