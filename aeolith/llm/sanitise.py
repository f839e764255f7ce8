"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities.  Over all documents, the distinct
words of each document are counted with its entities: a word t discloses an entity e where the
pointwise mutual information log p(e, t) / p(e) p(t) comes near the information
-log p(e) of the entity itself, that is, where seeing t nearly tells e.  Such
words are removed wherever they stand, less telling ones replaced by the class of
what they tell: the kind of entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .tokens import Slab, chain, slabs, string_buffers

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = bytes(b for b in range(128) if chr(b).isalnum() or chr(b) in "._%+-")
_IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)
_DOUBLED = np.array([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])
#: Bitmaps of hashes: 8 MB at any number of keys.
_SIEVE_BITS = 26


def luhn(digits: bytes) -> bool:
    d = np.frombuffer(digits, np.uint8)[::-1] - 48
    return (int(d[::2].sum()) + int(_DOUBLED[d[1::2]].sum())) % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; only runs that end at an @ can start one."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        # the run before the @, walked back in steps that double, so the whole search is linear
        step = 64
        while True:
            from_ = max(done, at - step)
            start = from_ + len(text[from_:at].rstrip(_LOCAL))
            if start > from_ or from_ == done:
                break
            step *= 2
        match = _EMAIL.match(text, start) if start < at else None
        if match:
            yield match.span()
            done = match.end()
        else:
            done = max(done, at)
        at = text.find(b"@", max(at + 1, done))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, sorted; a match that fails its check is dropped and not tried again."""
    out = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip(b"0")) < 4 and int(part) <= 255 for part in m[0].split(b".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].translate(None, _NO_DIGIT)
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(None, _NO_DIGIT)) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _starts(text: bytes) -> np.ndarray:
    """Bytes that begin a code point, counted before each place; bytes of ASCII texts count themselves."""
    return np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))


def _entity(text: bytes, span: tuple[int, int, int]) -> int:
    """A hash of the kind and the bare value, in lower case; its last two bits are the kind."""
    value = text[span[0] : span[1]].lower()
    if span[2] >= 2:
        value = value.translate(None, _NO_DIGIT)
    slab = Slab(np.frombuffer(value, np.uint8), np.array([0, len(value)]))
    kind = np.array([span[2]], np.uint64)
    return int(((chain([kind, *slab.hash[:, None]]) & ~np.uint64(3)) | kind).view(np.int64)[0])


def _free(text: bytes, spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words, by their bounds in the text, that are no part of an entity."""
    taken = np.zeros(len(text) + 1, bool)
    for s, e, _ in spans:
        taken[s:e] = True
    return np.flatnonzero(~(taken[start] | taken[end - 1]))


def _entities(text: bytes, spans: list[tuple[int, int, int]]) -> np.ndarray:
    return np.unique(np.array([_entity(text, span) for span in spans], np.int64)).view(np.uint64)


def _counted(parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The distinct rows of the parts, as columns of those names, and the number of each as n."""
    rows, n = np.unique(np.concatenate(parts), axis=0, return_counts=True) if parts else (np.zeros((0, len(names)), np.uint64), np.zeros(0, np.int64))
    columns = [pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in range(len(names))]
    return pa.record_batch([*columns, pa.array(n.astype(np.int64))], [*names, "n"])


def _entity_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, documents with it)."""
    for batch in batches:
        data, bounds = string_buffers(batch.column(0))
        parts = []
        for r in range(batch.num_rows):
            text = data[bounds[r] : bounds[r + 1]].tobytes()
            spans = base_spans(text)
            if spans:
                parts.append(_entities(text, spans)[:, None])
        yield _counted(parts, ["entity"])


class Bitmap:
    """Which hashes fall into wanted buckets, the first _SIEVE_BITS bits of a hash; one long holds 64 buckets."""

    def __init__(self, frame: DataFrame, column: str):
        bucket = F.shiftrightunsigned(column, 64 - _SIEVE_BITS)
        words = frame.select(F.shiftright(bucket, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - _SIEVE_BITS}) & 63 AS int))").alias("bit"))
        table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** (_SIEVE_BITS - 6) rows
        bits = np.zeros(1 << (_SIEVE_BITS - 6), np.int64)
        bits[table["word"].to_numpy()] = table["bits"].to_numpy()
        self.shared = frame.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = hashes >> np.uint64(64 - _SIEVE_BITS)
        return (self.shared.value[bucket >> np.uint64(6)] >> (bucket & np.uint64(63)) & np.uint64(1)).astype(bool)


def _pair_counts(wanted: Bitmap):
    """(entity, term, documents with both) for entities in wanted buckets and the free words of whole documents."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in slabs(batch.column(0)):
                parts = []
                for r in range(len(slab)):
                    text = slab.data[slab.bounds[r] : slab.bounds[r + 1]].tobytes()
                    spans = base_spans(text)
                    entities = _entities(text, spans) if spans else np.zeros(0, np.uint64)
                    entities = entities[wanted[entities]]
                    if not len(entities):
                        continue
                    lo, hi = slab.first[r], slab.first[r + 1]
                    free = _free(text, spans, slab.start[lo:hi] - slab.bounds[r], slab.end[lo:hi] - slab.bounds[r])
                    terms = np.unique(slab.hash[lo:hi][free])
                    parts.append(np.stack([np.repeat(entities, len(terms)), np.tile(terms, len(entities))], 1))
                if parts:
                    yield _counted(parts, ["entity", "term"])

    return counts


def _places(wanted: Bitmap):
    """(text key, term, start, end) of the free words, in all texts, that fall into wanted buckets."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            for rows, slab in slabs(batch.column("text")):
                out: list[np.ndarray] = []
                maybe = wanted[slab.hash]
                for r in np.unique(slab.row()[maybe]).tolist():
                    text = slab.data[slab.bounds[r] : slab.bounds[r + 1]].tobytes()
                    place = _starts(text)
                    lo, hi = slab.first[r], slab.first[r + 1]
                    start, end = slab.start[lo:hi] - slab.bounds[r], slab.end[lo:hi] - slab.bounds[r]
                    at = _free(text, base_spans(text), start, end)
                    at = at[maybe[lo:hi][at]]
                    out.append(np.stack([np.full(len(at), key[rows.start + r]), slab.hash[lo:hi][at].view(np.int64), place[start[at]], place[end[at]]], 1))
                if out:
                    yield pa.record_batch([pa.array(c) for c in np.concatenate(out).T.copy()], ["key", "term", "start", "end"])

    return places


def _document_counts(wanted: Bitmap):
    """(term, documents with it) for all words that fall into wanted buckets of the hash space."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for _, slab in slabs(batch.column(0)):
                at = np.flatnonzero(wanted[slab.hash])
                pairs = np.unique(np.stack([slab.hash[at], slab.row()[at].astype(np.uint64)], 1), axis=0)
                terms.append(pairs[:, 0])
            found, n = np.unique(np.concatenate(terms) if terms else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return counts


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("action", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = string_buffers(batch.column("text"))
        terms = batch.column("terms").to_pylist()
        out, clean = [], []
        for r in range(batch.num_rows):
            text = data[bounds[r] : bounds[r + 1]].tobytes()
            spans = base_spans(text)
            if not spans and not terms[r]:
                out.append([])
                clean.append(text.decode(errors="replace"))
                continue
            place = _starts(text)
            found = [{"start": int(place[s]), "end": int(place[e]), "kind": KINDS[k], "action": "replace"} for s, e, k in spans]
            found += [{"start": t["start"], "end": t["end"], "kind": "term", "action": t["action"], "of": KINDS[t["of"]]} for t in terms[r] or () if t["end"] < len(place)]
            found.sort(key=lambda x: (x["start"], (*KINDS, "term").index(x["kind"]), x["end"]))
            out.append([{k: x[k] for k in ("start", "end", "kind", "action")} for x in found])
            chars, parts, done = text.decode(errors="replace"), [], 0
            for x in found:
                if x["start"] >= done:
                    tag = f"[TERM OF {x['of'].upper()}]" if "of" in x else f"[{x['kind'].upper()}]"
                    parts += [chars[done : x["start"]], "" if x["action"] == "remove" else tag]
                done = max(done, x["end"])
            clean.append("".join(parts) + chars[done:])
        yield pa.record_batch([batch.column("row"), pa.array(out, pa.list_(_SPAN)), pa.array(clean, pa.string())], ["row", "spans", "sanitised"])


def sanitise(docs: DataFrame, keep: list[str], text: str = "text", min_documents: int = 3, generalise_from: float = 0.7, remove_from: float = 0.95) -> DataFrame:
    """The columns ``keep`` with ``spans`` (start, end, kind, action; code points, sorted) and the ``sanitised`` text.

    A term is any word that is no part of an entity.  It discloses an entity where
    their mutual information is at least ``generalise_from`` of the entity's own
    (removed from ``remove_from``) and both stand in ``min_documents`` documents or
    more, at any distance.  All its occurrences go, also in documents without
    entities.  Documents are counted row by row, so repeated rows count again.  Null
    texts are empty; bytes that are no UTF-8 are replaced.  A generalised term becomes
    the class ``[TERM OF kind]`` of the entity it tells most of.  Terms are kept by
    64-bit hash.  An empty table has no rows.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = texts.select(F.xxhash64("text", F.length("text")).alias("key"), "text")
    n = texts.count()
    entities = texts.mapInArrow(_entity_counts, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("with_entity"))
    entities = stored(entities.where(F.col("with_entity") >= min_documents), "entities")
    together = texts.mapInArrow(_pair_counts(Bitmap(entities, "entity")), "entity long, term long, n long")
    pairs = stored(together.groupBy("entity", "term").agg(F.sum("n").alias("together")).where(F.col("together") >= min_documents), "pairs")
    terms = texts.mapInArrow(_document_counts(Bitmap(pairs, "term")), "term long, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    information = F.log(F.lit(float(max(n, 2)))) - F.log("with_entity")
    shared = F.log(F.col("together").cast("double")) + F.log(F.lit(float(max(n, 2)))) - F.log("with_entity") - F.log("with_term")
    telling = pairs.join(terms, "term").join(entities, "entity").select("entity", "term", shared.alias("shared"), information.alias("information"))
    telling = telling.where((F.col("shared") > 0) & (F.col("shared") >= generalise_from * F.col("information")))
    action = F.when(F.col("shared") >= remove_from * F.col("information"), "remove").otherwise("generalise")
    # the class that stands for a generalised term: the kind of entity it tells most of
    telling = telling.groupBy("term").agg(F.max(action).alias("action"), F.max_by(F.col("entity").bitwiseAND(F.lit(3)), F.struct("shared", "entity")).cast("int").alias("of"))
    telling = stored(telling, "telling")
    places = keyed.mapInArrow(_places(Bitmap(telling, "term")), "key long, term long, start long, end long")
    told = places.join(telling, "term").groupBy("key").agg(F.collect_set(F.struct("start", "end", "action", "of")).alias("terms"))
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text", F.length("text"))).join(stored(told, "terms"), "key", "left").select("row", "text", "terms")
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_apply, f"row {kind}, spans array<struct<start:long,end:long,kind:string,action:string>>, sanitised string")
    return out.select("row.*", "spans", "sanitised")
