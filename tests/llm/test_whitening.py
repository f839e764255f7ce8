"""Whitening against one decomposition of all vectors in numpy, and exact sums."""

from fractions import Fraction

import numpy as np

from aeolith.llm import whitening

TABLES = "/root/testdata/sf0.001"


def literally(vectors, components=16):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), np.int64)
    n, total = len(fit), [int(s) for s in fit.sum(0)]
    mean = np.array([float(Fraction(s, n)) for s in total])
    centred = fit - mean
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, len(e))
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return n, deviation, (np.array(x) - mean) @ axes[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n string").repartition(4)


def collected(out):
    rows = {}
    for r in out.collect():
        rows.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return rows


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24)) + rng.normal(size=24) * 100
    vectors[:40] = vectors[40:80]
    n, deviation, white, explained = literally(vectors)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(vectors)]
    odd = [(1000, None, 0, "x"), (1001, [1.0, None] * 12, 0, "x"), (1002, [float("nan")] * 24, 0, "x"), (1003, [float("-inf")] * 24, 0, "x"), (1004, [], 0, "x"), (1005, [1.0, 2.0], 0, "x")]
    got = collected(whitening.whitened(table(spark, rows + odd), ["vec_id"]))
    assert sorted(got) == list(range(400)) and all(sorted(c) == list(range(1, 17)) for c in got.values())
    assert n == 360
    found = np.array([[got[i][k][0].whitened for k in range(1, 17)] for i in range(400)])
    sign = np.sign((found * white).sum(0))
    assert np.allclose(found * sign, white, rtol=1e-9, atol=1e-9)
    for i in range(400):
        r = got[i][5][0]
        assert (r.n, r.deviation) == (n, deviation[i]) and r.identity_error < 1e-9
        assert np.isclose(r.explained, explained[4], rtol=1e-9)


def test_moments_merge_in_any_order():
    x = np.random.default_rng(0).integers(10**6, 10**6 + 300, (90, 5)).astype(float)
    parts = [whitening.moments(p) for p in np.split(x, [1, 7, 60])]
    whole = whitening.moments(x)
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        total = parts[order[0]]
        for i in order[1:]:
            total = total.merged(parts[i])
        assert total.n == 90 and np.allclose(total.mean, whole.mean, rtol=1e-14) and np.allclose(total.scatter, whole.scatter, rtol=1e-10)


def test_whitening_of_few_vectors(spark):
    assert whitening.whitened(table(spark, []), ["vec_id"]).collect() == []
    assert whitening.whitened(table(spark, [(1, None, 0, "x")]), ["vec_id"]).collect() == []
    # one distinct vector has no component
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0], 0, "x"), (2, [1.0, 2.0], 0, "x")]), ["vec_id"]).collect() == []
    # two span one component; repeated rows, null ids and columns of clashing names stay
    out = whitening.whitened(table(spark, [(1, [0.0, 0.0], 0, "a"), (1, [0.0, 0.0], 0, "a"), (None, [1.0, 1.0], 0, "b")]).withColumnRenamed("n", "x"), ["vec_id", "x"]).collect()
    assert sorted((r.vec_id is None, r.x, r.component, r.n, r.deviation) for r in out) == [(False, "a", 1, 2, 8192)] * 2 + [(True, "b", 1, 2, 8192)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 and r.identity_error < 1e-12 for r in out)


def test_deviation_beyond_64_bits():
    model = whitening.Whitener(10**9, [10**15], np.ones((1, 1)), np.ones(1))
    assert model.deviation(np.array([[10**6 + 3], [10**6 + 10**4]])) == [9 * 10**18, None]


def test_query(spark):
    from aeolith.llm.queries import QUERIES

    vectors = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    got = collected(QUERIES["op13_embedding_whitening"](spark, TABLES))
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, deviation, _, explained = literally([v for _, v in rows])
    assert {r: got[r][1][0].deviation for r, _ in rows} == {r: d for (r, _), d in zip(rows, deviation, strict=True)}
    assert all(c[1][0].n == n and np.isclose(c[1][0].explained, explained[0]) for c in got.values())
