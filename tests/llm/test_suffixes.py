"""Substring removal against a dictionary of all windows, and the sorting against Python's."""

import hashlib
import random

import numpy as np
import pytest

from aeolith.llm import suffixes

TABLES = "/root/testdata/sf0.001"


def literally(rows, length):
    """(n_bytes, n_removed, n_spans, digest of the rest) for each distinct (id, text)."""
    docs = sorted({(float("inf") if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for i, digest, data in docs:
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = True
            seen.add(window)
        edge = np.diff(np.append(0, gone.astype(int)))
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i, digest] = (len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest(), rest)
    return [out[float("inf") if i is None else i, hashlib.sha256((t or "").encode()).hexdigest()] for i, t in rows]


def compared(spark, rows, length=100, **options):
    docs = spark.createDataFrame([(n, i, t, "x") for n, (i, t) in enumerate(rows)], "n long, doc_id long, text string, data string").repartition(3)
    out = sorted(suffixes.dedup_substrings(docs, ["n", "data"], length=length, content=True, **options).collect(), key=lambda r: r.n)
    got = [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in out]
    want = literally(rows, length)
    assert len(got) == len(want)
    for g, w, r in zip(got, want, rows, strict=True):
        assert g == w, r
    assert {r.data for r in out} <= {"x"}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(prose):
    """Texts with shared passages, copies with an edit, runs of one byte and rows of all odd kinds."""
    rng = random.Random(7)
    passages = [prose(rng.choice([12, 20, 60])) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 15))]
        rows.append((rng.randint(0, 10_000), " ".join(parts)))
    base = prose(150)
    for _ in range(30):
        cut = rng.randrange(len(base))
        rows.append((rng.randint(0, 10_000), base[:cut] + rng.choice(["", "Q", "other words "]) + base[cut + rng.randint(0, 5) :]))
    rows += [(20_000 + i, t) for i, t in enumerate(["z" * 1500, "z" * 99, "z" * 100, "z" * 101, "ab" * 300, None, "", "short", base, base])]
    return [*rows, (None, base), (None, passages[0] + passages[1]), (7, base + passages[2]), (7, passages[2] + base), rows[3], rows[3]]


def test_dedup_equals_brute_force(spark, corpus):
    compared(spark, corpus)


@pytest.mark.parametrize(("length", "group"), [(100, 3), (40, 5), (1, 1), (7, 2)])
def test_dedup_with_split_groups(spark, corpus, length, group):
    """Grams of more contexts than a task may sort are halved until they fit."""
    compared(spark, corpus, length=length, group=group)


def test_dedup_over_many_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "_STEP", 512)
    compared(spark, corpus)


def test_dedup_of_long_texts_and_none(spark, prose):
    long = prose(40_000)
    compared(spark, [(5, long), (3, long[1000:200_000]), (9, "q" * 300_000), (1, long[-5000:] + long[-5000:])])
    assert suffixes.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []
    compared(spark, [(1, None), (1, None), (2, "")])


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    from aeolith.llm.queries import QUERIES

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op12_suffix_dedup"](spark, TABLES).collect()}
    assert got == {i: w[:4] for (i, _), w in zip(rows, literally(rows, 100), strict=True)}


def test_deep_shallow_sort_equals_sorting():
    rng = np.random.default_rng(2)
    for width, letters in ((40, 2), (16, 3), (5, 4), (67, 1)):
        strings = rng.integers(0, letters, (500, width)).astype(np.uint8)
        strings[250:, : width - 3] = strings[:250, : width - 3]
        group = rng.integers(0, 4, 500)
        order, common = suffixes.deep_shallow_sort(strings, group)
        keys = [(group[i], strings[i].tobytes()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))
        for a, b, n in zip(keys, keys[1:], common[1:], strict=False):
            same = next((k for k in range(width) if a[1][k] != b[1][k]), width)
            assert n == (same if a[0] == b[0] else -1)


def test_blind_trie():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(12)).encode() for _ in range(300)]
    trie = suffixes.BlindTrie()
    for i, s in enumerate(strings):
        trie.insert(i, s)
    assert [strings[i] for i in trie.ordered()] == sorted(strings)
