"""Token alignment against the contract read literally, text by text."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest

from aeolith.llm import alignment

TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "The quick brown fox jumps over the lazy dog.",
    None,
    "",
    " ",
    "   lead and  double   blanks \n and\tlines \n\n end  ",
    "Größe, naïve, Ελληνικά, русский текст, 日本語の文章です。 emoji 👩‍👩‍👧 done",
    "<|endoftext|> <s> </s> <unk> <0x41> are plain",
    "a ▁ mark that reads as a blank",
    "no break and　wide em blank   x   y",
    "zero\x00byte \x1f unit \x85 next",
    "x" * 5000,
    "word " * 20_000,
    "don't I'll we've 's 'S 12345 3.14159 !!!??? a'b",
    "ﬁ ligature ½ Å Å",
    "﻿bom ​ zero width ▁",
]

TABLES = "/root/testdata/sf0.001"


def literally(texts):
    """Rows of the contract: whole texts are encoded, labels and links found position by position."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_file, b_file = alignment.read_tokenizers()
    a, b = Tokenizer.from_buffer(a_file), SentencePieceProcessor(model_proto=b_file)
    a.encode_special_tokens = True
    byte, vocabulary = alignment._byte_of_char(), {v: k for k, v in json.loads(a_file)["model"]["vocab"].items()}

    def of_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    rows, links = [], []
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        pa, pb = [bytes(byte[c] for c in vocabulary[i]) for i in ia], [of_b(i) for i in ib]
        if not text or not b"".join(pa) == b"".join(pb) == (" " + text).encode():
            ia, ib, pa, pb = [], [], [], []
        ends = [np.cumsum([len(x) for x in p]).astype(int) for p in (pa, pb)]
        starts = [e - [len(x) for x in p] for e, p in zip(ends, (pa, pb), strict=True)]
        found = [(ia[i], ib[j]) for i in range(len(ia)) for j in range(np.searchsorted(ends[1], starts[0][i], "right"), np.searchsorted(starts[1], ends[0][i], "left"))]
        both = sorted({*ends[0].tolist()} & {*ends[1].tolist()})
        groups = []
        for lo, hi in zip([0, *both], both, strict=False):
            groups.append("|".join(",".join(map(str, ids[np.searchsorted(e, lo, "right") : np.searchsorted(e, hi, "right")])) for ids, e in ((ia, ends[0]), (ib, ends[1]))))
        links.append(found)
        rows.append([len(ia), len(ib), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""])
    counts = Counter(x for found in links for x in found)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(*r[:4], sum(counts[x] == most[x[1]] for x in found), sum(counts[x] for x in found), r[4]) for r, found in zip(rows, links, strict=True)]


def result(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    out = alignment.align(docs.withColumnRenamed("n_a", "other"), ["doc_id", "other"], **options).collect()
    assert {r.other for r in out} <= {"kept"}
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(out, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 50, 0])
def test_alignment_equals_contract(spark, hot):
    """Whatever part of the pairs is broadcast."""
    assert result(spark, TEXTS, hot_pairs=hot) == literally(TEXTS)


def test_alignment_of_given_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    assert result(spark, texts) == literally(texts)


def test_alignment_when_memory_is_short(spark, monkeypatch):
    """A task that forgets its chunks finds the same."""
    files = alignment.read_tokenizers()
    aligner = alignment.Aligner(*files)
    texts = [t for t in TEXTS if t]
    data = np.frombuffer(b"".join(b" " + t.encode() for t in texts), np.uint8)
    bounds = np.append(0, np.cumsum([len(t.encode()) + 1 for t in texts]))

    def found():
        chunks, first = aligner.encode(data, bounds)
        return [[aligner.groups[i] for i in chunks[s:e]] for s, e in zip(first, first[1:], strict=False)]

    before = found()
    aligner.forget()
    assert found() == before
    aligner.cuts = False
    aligner.forget()
    joined = [None if None in g else ";".join(g) for g in before]
    assert [g[0] for g in found()] == joined


def test_alignment_empty_table_and_repeats(spark):
    assert result(spark, []) == []
    assert result(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
    docs = spark.createDataFrame([(None, "same text"), (7, "same text"), (7, "same text")], "doc_id long, text string")
    out = alignment.align(docs, ["doc_id"]).collect()
    assert len(out) == 3 and {(r.n_a, r.count_sum) for r in out} == {(2, 6)}


def test_query(spark):
    from aeolith.llm.queries import QUERIES

    rows = QUERIES["op11_token_alignment"](spark, TABLES).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all((r.n_a > 0) == bool(r.groups_sha256) for r in rows) and {r.doc_id for r in rows} == set(texts)
