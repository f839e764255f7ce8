"""Token groups and links between two tokenizers of the same text.

Each byte of a text has a label: no token ends there, one of A, one of B, or one of
both.  A regex scans the labels for spans up to each "both"; the labels in a span
count the tokens of a group.  A chunk is cut before a blank between two characters
that are not white: no token of either tokenizer crosses it, so chunks are encoded
and scanned once for each time the memory of a task has not seen them, and a text is
the sequence of its chunks.  Vocabularies that could cross such a blank are noticed
and get whole texts as chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored
from .tokens import SLAB_BYTES, string_buffers

TOKENIZERS = "/opt/tokenizers"
#: Chunks that a task remembers, and bytes of their strings and links, before it starts anew.
MEMORY_CHUNKS, MEMORY_BYTES = 600_000, 96_000_000
#: At most so many id pairs, the most frequent ones, go to all tasks (17 bytes each); the others are joined.
HOT_PAIRS = 1 << 17
#: Links that a task sums before it hands them on.
_SUMMED = 1 << 20

#: No token ends at the byte: 0; one of either: 1, 2; of both: 3.
_A, _B = 1, 2
_SPAN = re.compile(rb"[^\x03]*\x03", re.DOTALL)
#: What stands between two cuts: a blank before and nothing white at either end.
_INNER = re.compile(rb" (?!\s|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80).*(?<![\x00-\x20])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)", re.DOTALL)
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def read_tokenizers(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """The files of both tokenizers, about 2 MB; the driver reads them and sends them to the tasks."""
    return Path(folder, "byte_bpe_50k.json").read_bytes(), Path(folder, "piece_bpe_32k.model").read_bytes()


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _white(data: np.ndarray, at: np.ndarray, ends: bool) -> np.ndarray:
    """Whether a white character ends (or starts) at each place."""
    n = len(data)
    a, b, c = (data[np.clip(at + k, 0, n - 1)] for k in ((-2, -1, 0) if ends else (0, 1, 2)))
    two, last = ((b, c) if ends else (a, b)), c
    found = ((c if ends else a) <= 0x20) | (two[0] == 0xC2) & ((two[1] == 0x85) | (two[1] == 0xA0))
    found |= (a == 0xE1) & (b == 0x9A) & (last == 0x80)
    found |= (a == 0xE2) & (b == 0x80) & ((last <= 0x8A) & (last >= 0x80) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    return found | (a == 0xE2) & (b == 0x81) & (last == 0x9F) | (a == 0xE3) & (b == 0x80) & (last == 0x80)


class Aligner:
    """Encodes chunks with both tokenizers and keeps what it found of each.

    Of chunk ``i``: ``groups[i]`` the string of its groups (None where the bytes of the
    tokens are not those of the chunk), ``counts`` four numbers, ``links`` from
    ``first[i]`` to ``first[i + 1]`` the numbers of its pairs of ids, which ``pairs`` has
    (A << 32 | B).
    """

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        byte = _byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        # the decimal id of a token inside its group, and at its end
        self.a_text = np.array([f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))], object)
        self.b_text = np.array([f"{i}," for i in range(len(self.b_bytes))] + [f"{i};" for i in range(len(self.b_bytes))], object)
        cutter = json.loads(a_file).get("pre_tokenizer") or {}
        self.cuts = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.in_span: dict[bytes, tuple[int, int]] = {}
        self.number_of_pair: dict[int, int] = {}
        self.pairs = array("q")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[str | None] = []
        self.counts, self.links, self.first, self.bad, self.held = array("q"), array("q"), array("q", [0]), bytearray(), 0

    def tidy(self) -> None:
        """Starts anew if too much is kept."""
        if len(self.groups) > MEMORY_CHUNKS or self.held > MEMORY_BYTES or len(self.pairs) > MEMORY_CHUNKS:
            self.number_of_pair.clear()
            self.pairs = array("q")
            self.forget()

    def chunk_bounds(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bounds of the chunks of texts that each start with the added blank and are not empty."""
        if not self.cuts:
            return bounds
        inner = np.ones(len(data) + 1, bool)
        inner[bounds] = False
        at = np.flatnonzero((data == 0x20) & inner[:-1])
        at = at[inner[at + 1]]
        if len(at):
            # a chunk may start right after the blank of its text, so that blank counts as white
            at = at[~_white(data, at - 1, True) & ~_white(data, at + 1, False)]
        inner[:] = False
        inner[bounds] = inner[at] = True
        return np.flatnonzero(inner)

    def learn(self, chunks: list[bytes]) -> None:
        """Those between two cuts are encoded in one text, as they might stand in one; the others, and all if some token is not what it should be, each alone."""
        inner, lone = [], []
        for chunk in chunks:
            (inner if self.cuts and _INNER.fullmatch(chunk) else lone).append(chunk)
        if inner and not self.aligned(inner):
            lone += inner
        for chunk in lone:
            if not self.aligned([chunk]):
                self.known[chunk] = len(self.groups)
                self.groups.append(None)
                self.counts.extend((0, 0, 0, 0))
                self.first.append(len(self.links))
                self.bad.append(1)
                self.held += len(chunk) + 200

    def aligned(self, chunks: list[bytes]) -> bool:
        """Finds and keeps the groups and links of chunks that follow each other; False, and nothing kept, if tokens do not restore their bytes."""
        whole = b"".join(chunks)
        text = whole.decode("utf-8", "replace")
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return False
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        labels = np.zeros(len(whole), np.uint8)
        labels[a_end - 1] |= _A
        labels[b_end - 1] |= _B
        spans = _SPAN.findall(labels.tobytes())
        known = self.in_span if len(self.in_span) < 100_000 else self.in_span.clear() or self.in_span
        for span in {*spans} - known.keys():
            known[span] = (span.count(_A) + 1, span.count(_B) + 1)
        tokens = np.array([known[span] for span in spans], np.int64)  # of A and B in each group
        a_of, b_of = tokens[:, 0].cumsum(), tokens[:, 1].cumsum()
        # of each group first its tokens of A, then those of B
        out = np.empty(len(a) + len(b), object)
        a_group, b_group = np.repeat(np.arange(len(spans)), tokens[:, 0]), np.repeat(np.arange(len(spans)), tokens[:, 1])
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_of - 1] = b_last[b_of - 1] = 1
        out[np.arange(len(a)) + (b_of - tokens[:, 1])[a_group]] = self.a_text[a + a_last * len(self.a_bytes)]
        out[np.arange(len(b)) + a_of[b_group]] = self.b_text[b + b_last * len(self.b_bytes)]
        # tokens overlap up to each end of either
        ends = np.flatnonzero(labels)
        links = self.numbered(a[np.searchsorted(a_end, ends + 1)] << 32 | b[np.searchsorted(b_end, ends + 1)])
        size = np.array([len(c) for c in chunks])
        stop = np.cumsum(size)
        cuts = [np.append(0, np.searchsorted(x, stop, "right")) for x in (a_end, b_end, a_end[a_of - 1], ends + 1)]
        if (cuts[0][1:] == cuts[0][:-1]).any() or (a_end[cuts[0][1:] - 1] != stop).any() or (b_end[np.maximum(cuts[1][1:], 1) - 1] != stop).any():
            return False  # a token crosses a cut
        strings, places = out.tolist(), (cuts[0] + cuts[1]).tolist()
        number = len(self.groups)
        self.known.update(zip(chunks, range(number, number + len(chunks)), strict=True))
        self.groups += ["".join(strings[s:e])[:-1] for s, e in zip(places, places[1:], strict=False)]
        self.counts.frombytes(np.stack([np.diff(c) for c in cuts], 1).astype(np.int64).tobytes())
        self.first.frombytes((cuts[3][1:] + len(self.links)).astype(np.int64).tobytes())
        self.links.frombytes(links.astype(np.int64).tobytes())
        self.bad.extend(bytes(len(chunks)))
        self.held += len(whole) + 8 * len(links) + 8 * len(out) + 150 * len(chunks)
        return True

    def numbered(self, links: np.ndarray) -> np.ndarray:
        """The number of each link's pair."""
        pairs, at = np.unique(links, return_inverse=True)
        known = self.number_of_pair
        for pair in pairs.tolist():
            if pair not in known:
                known[pair] = len(self.pairs)
                self.pairs.append(pair)
        return np.array([known[p] for p in pairs.tolist()], np.int64)[at]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk, and the place of the first chunk of each text (one more at the end)."""
        cuts = self.chunk_bounds(data, bounds)
        raw, places = data.tobytes(), cuts.tolist()
        chunks = [raw[s:e] for s, e in zip(places, places[1:], strict=False)]
        numbers = list(map(self.known.get, chunks))
        if None in numbers:
            missing = [i for i, n in enumerate(numbers) if n is None]
            self.learn(list({chunks[i]: None for i in missing}))
            for i in missing:
                numbers[i] = self.known[chunks[i]]
        return np.array(numbers, np.int64), np.searchsorted(cuts, bounds)

    def links_of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs of the chunks' links, one after the other, and how many each chunk has."""
        first, links = np.frombuffer(self.first, np.int64), np.frombuffer(self.links or array("q", [0]), np.int64)
        n = first[chunks + 1] - first[chunks]
        return links[np.repeat(first[chunks] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


_aligners: dict[str, Aligner] = {}


def _aligner(files: tuple[bytes, bytes]) -> Aligner:
    """One for each pair of files and process."""
    name = hashlib.sha256(b"".join(files)).hexdigest()
    if name not in _aligners:
        _aligners[name] = Aligner(*files)
    return _aligners[name]


def _texts(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, which of them have a text, bytes of " " + text of these, their bounds), in slabs of bounded size; a longer text is a slab of its own."""
    data, bounds = string_buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLAB_BYTES, "right")) - 1)
        own = bounds[i : j + 1] - bounds[i]
        there = np.flatnonzero(np.diff(own))
        moved = np.insert(data[bounds[i] : bounds[j]], own[there], 0x20)
        yield slice(i, j), there, moved, np.append(own[there] + np.arange(len(there)), len(moved))
        i = j


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, minlength=len(keys)).astype(np.int64)


_ALIGNED = ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, pairs array<long>, times array<int>"


def _align(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row its counts, the digest of its groups, and its id pairs with the number of links of each."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for batch in batches:
            for rows, there, data, bounds in _texts(batch.column(0)):
                n = rows.stop - rows.start
                numbers, texts = np.zeros((n, 4), np.int64), [""] * n
                pairs, times, sizes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(n, np.int64)
                if len(there):
                    chunks, first = aligner.encode(data, bounds)
                    bad = np.add.reduceat(np.frombuffer(bytes(aligner.bad), np.uint8)[chunks].astype(np.int64), first[:-1])
                    strings = aligner.groups
                    for row, ok, s, e in zip(there.tolist(), (bad == 0).tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                        if ok:
                            texts[row] = hashlib.sha256(";".join([strings[i] for i in chunks[s:e].tolist()]).encode()).hexdigest()
                    whole = np.repeat(bad == 0, np.diff(first))
                    chunks, row_of = chunks[whole], np.repeat(there, np.diff(first))[whole]
                    of = np.frombuffer(aligner.counts or array("q", [0] * 4), np.int64).reshape(-1, 4)[chunks]
                    numbers = np.stack([np.bincount(row_of, of[:, k], minlength=n) for k in range(4)], 1).astype(np.int64)
                    links, each = aligner.links_of(chunks)
                    most = max(len(aligner.pairs), 1)
                    own = np.sort(np.repeat(row_of, each) * most + links)
                    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                    pairs = np.frombuffer(aligner.pairs, np.int64)[own[cut] % most] if len(own) else pairs
                    times = np.diff(np.append(cut, len(own))).astype(np.int32)
                    sizes = np.bincount(own[cut] // most, minlength=n)
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                columns = [batch.column(1)[rows], *(pa.array(numbers[:, k]) for k in range(4)), pa.array(texts)]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, ["__row", *_COUNTS, "groups_sha256", "pairs", "times"])
                aligner.tidy()

    return align


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's links, handed on whenever they are many."""
    keys, times, held = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *times]))

    for batch in batches:
        keys.append(batch.column(0).flatten().to_numpy())
        times.append(batch.column(1).flatten().to_numpy())
        held += len(keys[-1])
        if held > _SUMMED:
            pairs, n = summed()
            if 2 * len(pairs) > _SUMMED:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                pairs, n = pairs[:0], n[:0]
            keys, times, held = [pairs], [n], len(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])


def _look_up(hot) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the links of hot pairs, and the other pairs with their numbers."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = hot.value
        for batch in batches:
            n = batch.num_rows
            given, times, sizes = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(n), sizes)
            place = np.minimum(np.searchsorted(pairs, given), max(len(pairs) - 1, 0))
            found = pairs[place] == given if len(pairs) else np.zeros(len(given), bool)
            sums = np.zeros((2, n + 1), np.int64)
            for k, of in enumerate((best.astype(np.int64), counts)):
                np.cumsum(np.append(0, np.bincount(row[found], minlength=n)), out=sums[k])
                total = np.append(0, np.cumsum(times[found] * of[place[found]]))
                sums[k] = total[sums[k]]
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[~found], minlength=n))).astype(np.int32))
            columns = [batch.column(0), *(pa.array(np.diff(x)) for x in sums), pa.ListArray.from_arrays(offsets, pa.array(given[~found])), pa.ListArray.from_arrays(offsets, pa.array(times[~found]))]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "best", "total", "pairs", "times"])

    return look_up


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) for each id pair (A << 32 | B) of the rows (pairs, times): its links in all of them, and whether no other pair of its B id has more."""
    counts = stored(aligned.select("pairs", "times").mapInArrow(_count_links, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.expr("pair & 4294967295")
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    out = stored(counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted-pairs")
    drop(counts)
    return out


def _hot_part(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The pairs counted at least so often that no more than ``most`` are, and that number."""
    bits = F.length(F.bin("n"))
    above, least = 0, 62
    for level, n in sorted(map(tuple, counts.groupBy(bits.alias("bits")).count().collect()), reverse=True):  # at most 63 rows
        above += n
        if above > most:
            break
        least = level - 1
    table = counts.where(F.col("n") >= F.lit(1 << least)).orderBy("pair").toArrow()
    return tuple(table[c].to_numpy() for c in ("pair", "n", "best")), 1 << least


def align(docs: DataFrame, keep: list[str], text: str = "text", tokenizers: str = TOKENIZERS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The columns ``keep`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row for each row.

    ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``: ids of A and B in order.  A
    link is a pair of tokens of both whose bytes overlap; an id pair counts its links
    in all texts, rows of one text each for themselves.  ``n_best`` counts the links
    whose pair no other pair of its B id exceeds, ``count_sum`` adds the counts of all
    links.  Texts that are null, empty or not restored by both tokenizers have zeros and
    an empty string.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizers(tokenizers))
    packed = docs.select(F.col(text).cast("string").alias("__text"), F.struct(*keep).alias("__row"))
    aligned = packed.mapInArrow(_align(shared), f"__row {packed.schema['__row'].dataType.simpleString()}, {_ALIGNED}")
    rows = stored(aligned.withColumn("__id", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    table, least = _hot_part(counts, hot_pairs)
    hot = docs.sparkSession.sparkContext.broadcast(table)
    found = rows.select("__id", "pairs", "times").mapInArrow(_look_up(hot), "__id long, best long, total long, pairs array<long>, times array<int>")
    lone = found.select("__id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__id", "x.pairs", "x.times")
    other = counts.where(F.col("n") < F.lit(least)).select(F.col("pair").alias("pairs"), "n", "best")
    parts = lone.join(other, "pairs").select("__id", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("best"), (F.col("times") * F.col("n")).alias("total"))
    summed = found.select("__id", "best", "total").unionByName(parts).groupBy("__id").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    out = rows.drop("pairs", "times").join(summed, "__id")
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], *_COUNTS, "n_best", "count_sum", "groups_sha256")
