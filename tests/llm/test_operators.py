"""Each operator against brute force on small tables, and its defined results on odd ones."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aeolith.llm import components, decontaminate, forest, jaccard, licenses, lines, mixing, resample, sanitise, storage, toxicity, warc
from aeolith.llm import queries as Q

from .test_tokens import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, dropped string, words string"
LONG = " ".join(f"w{i % 997}" for i in range(70_000))


def documents(spark, rows):
    """rows of (id, text) or (id, text, source) as a table with extra columns of clashing names."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(2)


ODD = [(1, None), (2, ""), (3, "   \n\n"), (None, "no id here at all, none"), (4, LONG), (5, "same text of five words"), (5, "same text of five words"), (6, "same text of five words")]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta", "vo"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_resampling_parts_good_from_bad(spark, prose):
    good = [(1000 + i, prose(40) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(40).split())) for i in range(20)]
    docs = documents(spark, good + bad + ODD)
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(40)] + [(100 + i, 0) for i in range(10)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = resample.importance_resampling(docs, labels, ["doc_id", "row"]).collect()
    chosen = {r.doc_id for r in out if r.selected}
    assert {i for i, _ in good} <= chosen and not {i for i, _ in bad} & chosen and len(out) == 88
    assert all(r.log_weight == 0 for r in out if r.doc_id in (1, 2, 3))
    again = resample.importance_resampling(docs, labels, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.gumbel_key) for r in out) == sorted((str(r.doc_id), r.gumbel_key) for r in again)


def test_resampling_without_labels_keeps_all(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.selected for r in resample.importance_resampling(docs, none, ["doc_id"]).collect())
    assert resample.importance_resampling(docs.limit(0), none, ["doc_id"]).count() == 0


def test_border_has_fewest_errors(spark):
    """Without held-out bad rows all are kept; where words tell nothing, noise decides, and the border is still the best of all."""
    docs = documents(spark, [(i, "the same words in every row") for i in range(60)])
    good = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    assert all(r.selected for r in resample.importance_resampling(docs, good, ["doc_id"]).collect())
    mixed = good.withColumn("quality", F.expr("IF(doc_id % 3 = 0, 0, 1)"))
    out = resample.importance_resampling(docs, mixed, ["doc_id"]).withColumn("held", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(resample.BORDER_FOLD)) == 0).collect()
    held = [(r.gumbel_key, r.doc_id % 3 > 0, r.selected) for r in out if r.held]
    errors = {c: sum(g if k <= c else not g for k, g, _ in held) for c in [-math.inf, *(k for k, _, _ in held)]}
    best = min(c for c in errors if errors[c] == min(errors.values()))
    assert held and all(s == (k > best) for k, _, s in held)


def test_top_k_equals_sorting(spark, prose):
    docs = documents(spark, [(i, prose(20)) for i in range(100)] + ODD)
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(3, 0)], "doc_id long, quality int")
    out = resample.importance_resampling(docs, labels, ["doc_id"], share=0.3).collect()
    best = sorted((r.gumbel_key for r in out), reverse=True)[round(0.3 * len(out)) - 1]
    assert {r.doc_id for r in out if r.selected} == {r.doc_id for r in out if r.gumbel_key >= best}
    assert not any(r.selected for r in resample.importance_resampling(docs, labels, ["doc_id"], share=0.0).collect())
    assert all(r.selected for r in resample.importance_resampling(docs, labels, ["doc_id"], share=1.0).collect())
    values = spark.createDataFrame([(float(x),) for x in [3, 3, 3, 1, 2, 2, -5]], "v double")
    assert [resample.kth_largest(values, "v", k) for k in range(1, 9)] == [3, 3, 3, 2, 2, 1, -5, -5]


def test_gumbel_keys_sample_in_proportion(spark):
    weights = {0: 1.0, 1: 2.0, 2: 5.0}
    df = spark.range(9000).selectExpr("id DIV 3 AS trial", "id % 3 AS item")
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("item").cast("int"))
    top = df.withColumn("k", F.log(w) + resample.gumbel(F.col("trial"), F.col("item"))).groupBy("trial").agg(F.max_by("item", "k").alias("item"))
    share = {r.item: r["count"] / 3000 for r in top.groupBy("item").count().collect()}
    assert all(abs(share[i] - weights[i] / 8) < 0.04 for i in weights)


# --- 2 ---------------------------------------------------------------------------------------------------------------

PAGES = [(5, "u5", "<p>a</p>"), (3, "u3", "<p>a</p>"), (9, None, None), (8, "u8", ""), (7, "u\r\n7", "é" * 30_000), (11, "x", "<p>a</p>"), (None, "n", "lone"), (12, "d", "twice"), (12, "d", "twice")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string")
    folder, listed = warc.write_archives(pages)
    out = warc.reassembled(warc.read_records(spark, folder, listed)).collect()
    assert len(out) == len(PAGES) and not any(r.error for r in out)
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html in PAGES:
        payload = (html or "").encode()
        for r in by[None if i is None else str(i)]:
            assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert r.record_type == "revisit" or bytes(r.payload) == payload
    assert [by[k][0].record_type for k in ("3", "5", "11", "8", "9", "7")] == ["response", "revisit", "revisit", "response", "revisit", "response"]
    assert by["5"][0].refers_to == "3" and by["9"][0].refers_to == "8" and [r.record_type for r in by["12"]] == ["response", "response"]


def test_small_payloads_are_responses(spark):
    folder, listed = warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), min_revisit_bytes=3)
    assert {r.record_type for r in warc.reassembled(warc.read_records(spark, folder, listed)).collect()} == {"response"}


def test_empty_table_of_pages(spark):
    folder, listed = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.reassembled(warc.read_records(spark, folder, listed)).count() == 0


def test_segments_are_verified(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.encode_chunked(b"abcdefgh", 3)
    digest = "sha1:" + warc.base32_sha1(b"abcdefgh")

    def result(parts, total):
        rows = [("o", n, total if last else None, "response" if n == 1 else "continuation", "1", None, digest if n == 1 else None, bytearray(b)) for n, b, last in parts]
        return warc.reassembled(spark.createDataFrame(rows, warc._RECORD)).first()

    a, b, c = block[:20], block[20:50], block[50:]
    whole = result([(3, c, True), (1, a, False), (2, b, False)], len(block))
    assert whole.error is None and bytes(whole.payload) == b"abcdefgh"
    assert result([(1, a, False), (3, c, True)], len(block)).error
    assert result([(1, a, False), (2, b, False), (3, c, True)], len(block) + 1).error
    assert result([(1, a, False), (1, a, False), (2, b, False), (3, c, True)], len(block)).error


def test_long_payloads_of_frequent_bodies(spark):
    """A payload of 400 segments, and one body that 1,200 pages share: dealt, the smallest id stays the response."""
    long = "".join(chr(97 + i % 26) for i in range(16 * 1024 * 400))
    pages = spark.range(1200).selectExpr("id + 10 AS page_id", "'u' AS url", "'same' AS html").unionByName(spark.createDataFrame([(1, "l", long), (2, "l", long)], "page_id long, url string, html string"))
    folder, listed = warc.write_archives(pages.repartition(3))
    out = {r.page_id: r for r in warc.reassembled(warc.read_records(spark, folder, listed)).collect()}
    assert len(out) == 1202 and not any(r.error for r in out.values())
    assert bytes(out["1"].payload) == long.encode() and out["2"].refers_to == "1" and out["2"].payload_bytes == len(long)
    assert [k for k, r in out.items() if r.record_type == "response"] in (["1", "10"], ["10", "1"]) and {r.refers_to for k, r in out.items() if int(k) > 10} == {"10"}


def test_malformed_records_are_rows_with_errors(spark, tmp_path):
    def gz(data):
        return gzip.compress(data)

    good = warc.response_records(1, "u", b"fine", "2024-01-01T00:00:00Z")[0]
    http = b"HTTP/1.1 200 OK\r\n\r\nx"
    number = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Page-ID", 2), ("WARC-Segment-Number", "two")], http)
    nameless = warc.record([("WARC-Type", "response")], http)
    sizeless = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\n"
    files = {"a": [good, number, nameless, good], "b": [good, sizeless, good], "c": [b"junk\r\n\r\n"], "e": []}
    packed = {k: b"".join(x if x[:2] == b"\x1f\x8b" else gz(x) for x in v) for k, v in files.items()}
    packed["d"] = packed["a"][: len(packed["a"]) - 60]
    packed["f"] = b"no gzip at all"
    for k, v in packed.items():
        (tmp_path / k).write_bytes(v)
    listed = spark.createDataFrame([(k,) for k in packed], "file string")
    out = warc.reassembled(warc.read_records(spark, f"file://{tmp_path}", listed)).collect()
    whole = [r for r in out if not r.error]
    assert len(whole) == 4 and {bytes(r.payload) for r in whole} == {b"fine"}  # two of a, one each of b and d
    assert sorted(r.error.split(":")[0] for r in out if r.error) == ["b", "c", "d", "f", *["fields are missing or no numbers"] * 4]
    assert [r.page_id for r in out if r.error and r.page_id] == ["2", "2"]


def test_chunk_framing():
    assert warc.decode_chunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.decode_chunked(bad)
    records = warc.response_records(1, "u", b"x" * 100, "d", 60)
    packed = b"".join(zlib.compress(r, 1, 31) for r in records)
    assert b"".join(b for _, b in warc.parse_records(io.BytesIO(packed))).endswith(b"0\r\n\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.parse_records(io.BytesIO(packed[: len(packed) // 2])))


# --- 3 ---------------------------------------------------------------------------------------------------------------


def kneser_ney(context, symbol, own, everything):
    """Interpolated Kneser-Ney by counting in dictionaries: own and everything are lists of words as tuples of symbols."""

    def count(k, gram, texts):
        at = [(w, i) for w in texts for i in range(len(w) - k + 1) if w[i : i + k] == gram]
        before = {w[i - 1] for w, i in at if i}
        top = toxicity.SHARED_ORDER + 1 if texts is everything else toxicity.ORDER
        return len(before) if before and k < top else len(at)

    symbols = range(256)
    total = sum(count(1, (x,), everything) for x in symbols)
    p = (count(1, (symbol,), everything) + 1) / (total + 256)
    for k in range(2, min(toxicity.ORDER, len(context) + 1) + 1):
        texts = everything if k <= toxicity.SHARED_ORDER else own
        after = [count(k, (*context[-(k - 1) :], x), texts) for x in symbols]
        if sum(after):
            p = max(after[symbol] - toxicity.DISCOUNT, 0) / sum(after) + toxicity.DISCOUNT * sum(n > 0 for n in after) / sum(after) * p
    return p


def test_models_equal_kneser_ney_and_sum_to_one(spark):
    texts = [("abba abba cab", 0), ("abc abba Bac", 0), ("cab cab bacabac", 1), ("bac cab", 1), ("abcab zz", None)]
    df = spark.createDataFrame([(label, t) for t, own in texts for label in (own, -1) if label is not None], "label int, text string").repartition(2)
    rows = df.mapInArrow(toxicity._count_grams, "label int, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).collect()
    grams = sorted({r.gram for r in rows if r.label >= 0})
    n = {(r.label, r.gram): r.n for r in rows}
    shared = [g for label, g in n if label < 0]
    m = toxicity.Models(np.array(grams), np.array([[n.get((c, g), 0) for c in (0, 1)] for g in grams]), np.array(shared), np.array([float(n[-1, g]) for g in shared]))
    split = {label: [(1, *w.encode(), 2) for t, own in texts if own == label for w in t.lower().split()] for label in (0, 1, None)}
    everything = [w for ws in split.values() for w in ws]
    pack = lambda symbols: np.int64(sum(x << 8 * i for i, x in enumerate(reversed(symbols[-toxicity.ORDER :]))))
    for context in [(1,), (1, 97), (1, *b"ab"), tuple(b"bacab"), tuple(b"qab"), (1, *b"zz")]:
        p = m.probabilities(np.array([pack((*context, x)) for x in range(256)]))
        assert np.allclose(p.sum(0), 1)
        for x in (2, 97, 98, 122):
            assert np.allclose(p[x], [kneser_ney(context, x, split[c], everything) for c in (0, 1)])
    r = m.ratios(np.frombuffer(b"abbacab", np.uint8), np.array([0, 4]), np.array([4, 7]))
    assert r[0] < 0 < r[1]


def test_toxicity_separates_held_out_rows(spark, prose):
    rows, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        text = prose(30) + (" loser" + random.Random(i).choice(["ist", "en", "um", "ack"]) + " scum" if toxic else "") + " " + prose(10)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows + [(900 + i, t) for i, (_, t) in enumerate(ODD)])
    given = spark.createDataFrame([*labels, (None, 1), (5000, 0), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, given, ["doc_id"], train=F.col("doc_id") % 4 != 2).collect()}
    held = [(out[i], y) for i, y in labels if i % 4 == 2]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert all(0 <= s <= 1 for s in out.values()) and out[900] == out[901] == out[902] < 0.3


def test_contradicting_labels_and_empty_tables(spark):
    both = spark.createDataFrame([(5, 0), (5, 1), (6, 1), (4, 0)], "doc_id long, toxic int")
    docs = documents(spark, ODD)
    assert len(toxicity.toxicity(docs, both, ["doc_id"]).collect()) == len(ODD)
    assert toxicity.toxicity(docs.limit(0), both, ["doc_id"]).count() == 0


def test_toxicity_without_a_class_scores_zero(spark):
    given = spark.createDataFrame([(5, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(documents(spark, ODD), given, ["doc_id"]).collect()} == {0.0}


# --- 4 ---------------------------------------------------------------------------------------------------------------


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def docs_codes(spark, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(lines.word_codes(F.col("t"))).collect()]


def test_lines_exact_and_fuzzy(spark, prose):
    base = prose(400)
    near = " ".join("zzz" if i == 30 else w for i, w in enumerate(base.split()))
    rows = [(1, f"{base}\nfirst own line of one"), (2, f"{near}\nsecond own line of two\n{base.upper()}!!"), (3, f"---\n{prose(12)}\n---"), (4, "first  OWN line, of one")]
    out = {r.doc_id: r for r in lines.dedup_lines(documents(spark, rows), ["doc_id", "dropped"]).collect()}
    assert out[1].n_dropped == 0 and out[1].deduplicated.startswith(base)
    assert out[2].deduplicated == "second own line of two" and out[2].n_dropped == 2
    assert out[3].n_dropped == 0 and out[4].deduplicated == "" and out[4].dropped == "y"
    assert edit(norm(base).split(), norm(near).split()) == 1
    codes = docs_codes(spark, ["a b c d", "a x c", ""])
    assert [len(c) for c in codes] == [4, 3, 0] and codes[0][0] == codes[1][0] and codes[0][2] == codes[1][2]


def test_lines_odd_rows(spark):
    out = [(r.doc_id, r.n_lines, r.n_dropped) for r in lines.dedup_lines(documents(spark, ODD), ["doc_id"]).collect()]
    assert sorted(out, key=str) == sorted([(1, 0, 0), (2, 1, 0), (3, 3, 0), (None, 1, 0), (4, 1, 0), (5, 1, 0), (5, 1, 0), (6, 1, 1)], key=str)
    assert lines.dedup_lines(documents(spark, ODD).limit(0), ["doc_id"]).count() == 0


def alike(a, b):
    return edit(a.split(), b.split()) <= math.floor(max(len(a.split()), len(b.split())) * 0.2 + 1e-9)


def test_dedup_equals_brute_force_components(spark, prose):
    """Of each group by edit similarity alone, over all pairs of lines of up to 12 words, the first stays."""
    rng = random.Random(5)
    rows = []
    for n in (4, 5, 6, 8, 9, 12):
        for _ in range(4):
            base = prose(n).split()
            for _ in range(5):
                w = list(base)
                for _ in range(rng.randint(0, 3)):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice(([], ["q" * rng.randint(1, 5)], [w[at], "put"]))
                rows.append((len(rows), " ".join(w[:12])))
    rng.shuffle(rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a == b or alike(a, b) and min(len(a.split()), len(b.split())) >= 4:
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    want = {i for i in root if find(i) != i}
    got = {r.doc_id for r in lines.dedup_lines(documents(spark, rows), ["doc_id"]).collect() if r.n_dropped}
    assert got == want and 30 < len(want) < len(rows) - 24


def test_lines_are_split_once_and_sketches_count_edits(spark, prose):
    """A filter on words made the plan split each line twice; a word put in changes one bit of a sketch, a replaced one at most two."""
    base = prose(40).split()
    texts = [" ".join(base), " ".join([*base, "put"]), " ".join(["new", *base[1:]]), "--\n" + " ".join(base)]
    docs = documents(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    read = lines._read_lines(docs, 4)
    splits = read._jdf.queryExecution().optimizedPlan().toString().count(r"[\x00-\x2F\x3A")
    assert splits == 1
    rows = {(r.id, r.pos): r for r in read.collect() if r.n_words}
    assert sorted(rows) == [(0, 0), (1, 0), (2, 0), (3, 1)] and rows[3, 1].k1 == rows[0, 0].k1 != rows[1, 0].k1

    def differ(i, j):
        return sum(((rows[i][c] ^ rows[j][c]) & (1 << 64) - 1).bit_count() for c in lines._SKETCH)

    assert differ((0, 0), (3, 1)) == 0 and differ((0, 0), (1, 0)) == 1 and differ((0, 0), (2, 0)) in (0, 2)
    assert differ((1, 0), (2, 0)) in (1, 3) and len(set(rows[0, 0]["keys"]) & set(rows[1, 0]["keys"])) >= lines.KEYS - 1


def test_dedup_keeps_sketches_out_of_bucket_tables(spark, monkeypatch):
    """Tables with a row for each line of each bucket hold a few longs a row, far less than the table of lines with keys and sketches."""
    rng = random.Random(11)
    heads = [" ".join(f"{rng.choice('bdgklmn')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(30)) for _ in range(20)]
    rows = [(i, f"{rng.choice(heads)} " + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(400)]
    sizes = {}

    def stored(df, name):
        out = storage.stored(df, name)
        sizes[name] = sum(x.stat().st_size for x in Path(out._stored_path.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(lines, "stored", stored)
    settings = {"parquet.enable.dictionary": "false", "spark.sql.parquet.compression.codec": "uncompressed"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert lines.dedup_lines(documents(spark, rows), ["doc_id"]).count() == len(rows)
    finally:
        for k in settings:
            spark.conf.unset(k)
    print({k: round(v / sizes["lines"], 2) for k, v in sizes.items()})
    assert sizes["bucket-members"] < sizes["lines"] and sizes["placed"] < 1.5 * sizes["lines"]


def test_buckets_of_two_lines_are_compared_once_and_garbage_is_collected(spark, monkeypatch):
    """Two lines that share a key without being similar stood in the tables of the second comparison; the driver kept what ended jobs left."""
    rows = [(2 * i + j, f"head{i}a head{i}b head{i}c head{i}d " + " ".join(f"own{i}x{j}y{k}" for k in range(6))) for i in range(20) for j in range(2)]
    rows += [(100 + j, "wide1 wide2 wide3 wide4 wide5 " + " ".join(f"other{j}y{k}" for k in range(6))) for j in range(3)]
    counts = {}

    def stored(df, name):
        out = storage.stored(df, name)
        counts[name] = out.count()
        return out

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Scavenge" not in b.getName())

    monkeypatch.setattr(lines, "stored", stored)
    before = collections()
    assert all(r.n_dropped == 0 for r in lines.dedup_lines(documents(spark, rows), ["doc_id"]).collect())
    assert collections() >= before + 2
    assert counts["hubs"] >= 43 and 0 < counts["placed"] <= 3 * 2


def test_words_are_parted_without_filters_and_lines_alone_meet_no_last_join(spark, monkeypatch):
    """Sketches asked each word six times in filters; lines in no group stood in the last joins, and sketches were gathered apart from the lines."""
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(8))) for i in range(60)]
    rows += [(100 + i, " ".join(["put" * i, *(f"near{j}" for j in range(8))])) for i in range(3)] + [(200 + i, "told twice") for i in range(2)]
    docs = documents(spark, rows)
    read = lines._read_lines(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text"), 4)
    assert "filter(" not in read._jdf.queryExecution().optimizedPlan().toString()
    for r in read.collect():
        # an even number of words in a class leaves no bit
        bits = sum((r[c] & (1 << 64) - 1).bit_count() for c in lines._SKETCH) if r.n_words >= 4 else 0
        assert r.n_words < 4 or bits <= r.n_words and (r.n_words - bits) % 2 == 0 and bits >= r.n_words - 4
    counts = {}

    def stored(df, name):
        out = storage.stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(lines, "stored", stored)
    gone = {r.doc_id for r in lines.dedup_lines(docs, ["doc_id"]).collect() if r.n_dropped}
    assert gone == {101, 102, 201} and "sketches" not in counts
    assert counts["unique-lines"] == 64 and 3 <= counts["grouped"] <= 10 and counts["owners"] == 4


def test_dedup_recall_of_similar_pairs(spark, capsys):
    """Pairs of lines against edit similarity alone, not the keys: at the threshold exactly, with words replaced, left out and put in."""
    rng = random.Random(8)
    pairs = []
    for n in (4, 5, 6, 9, 10, 12, 14, 15, 20, 40, 100):
        for _ in range(40):
            a = [f"w{rng.randrange(10**9):x}" for _ in range(n)]
            b, k = list(a), n // 5
            for i in sorted(rng.sample(range(n), k), reverse=True):
                b[i : i + 1] = rng.choice(([], ["new" + b[i]], [b[i], "put" + b[i]])) if n > 5 else ["new" + b[i]]
            if n == 4:
                b.insert(rng.randrange(5), "put")
            pairs.append((n, " ".join(a), " ".join(b)))
    long = [f"v{i}" for i in range(9000)]
    pairs.append((9000, " ".join(long), " ".join(["x", *long[2:]])))
    pairs.append((10, " ".join(["x", "y"] * 5), " ".join(["x", "y"] * 3 + ["z", "y", "z", "y"])))
    docs = documents(spark, [row for i, (_, a, b) in enumerate(pairs) for row in ((2 * i, a), (2 * i + 1, b))])
    gone = {r.doc_id for r in lines.dedup_lines(docs, ["doc_id"]).collect() if r.n_dropped}
    want = [(n, 2 * i + 1) for i, (n, a, b) in enumerate(pairs) if n == 9000 or alike(a, b)]
    with capsys.disabled():
        for n in sorted({n for n, _ in want}):
            of = [i for m, i in want if m == n]
            found = sum(i in gone for i in of)
            print(f"lines of {n} words: {found} of {len(of)} similar pairs found")
            assert found == len(of) if n <= lines.KEYS + 2 or n == 9000 else found >= 0.9 * len(of)
    assert gone <= {i for _, i in want} and len(want) > 300


def test_lookup_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "_HOT_ROWS", 5)
    rows = spark.range(100).selectExpr("id", "CASE WHEN id < 60 THEN 1 WHEN id < 97 THEN id ELSE NULL END AS k")
    table = spark.range(0, 90).selectExpr("id AS k", "id * 2 AS v")
    got = {r.id: r.v for r in components.lookup(rows, "k", table, "left").collect()}
    assert got == {i: 2 if i < 60 else 2 * i if i < 90 else None for i in range(100)}
    assert components.lookup(rows, "k", table).count() == 90


# --- 5 ---------------------------------------------------------------------------------------------------------------


def contaminated(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    its |= own
        out.append((d, len(w), len(hit), sorted(its)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_contamination_like_brute_force(spark, prose, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(i, prose(n)) for i, n in enumerate((20, 13, 14, 5, 1, 40))] + [(50, ""), (51, None), (52, "a a a a a a a a a a a a a a a")]
    rows = ODD[:5] + [(20 + i, f"{prose(9)} {' '.join((items[i % 6][1]).upper().split())} {prose(30)}") for i in range(12)] + [(60, "a " * 40), (61, items[0][1] + "." + items[0][1])]
    docs, bench = documents(spark, rows), spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, row string")
    got = decontaminate.contamination(docs, bench, ["doc_id"]).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == contaminated(rows, items)


def test_contamination_of_nothing(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(docs, none, ["doc_id", "text"]).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), none, ["doc_id"]).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def jaccard_links(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = words(t)
        if w and i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in sets}


@pytest.mark.parametrize("block", [256, 3])
def test_near_documents_like_brute_force(spark, prose, block):
    rng, rows = random.Random(2), [r for r in ODD if r[0] != 5]
    for g in range(6):
        base = prose(120).split()
        for k in range(7):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(120)] = "new"
            rows.append((100 + 10 * g + k, " ".join(w)))
    rows += [(200, rows[-1][1]), (201, rows[-1][1] + "!")]
    out = jaccard.near_documents(documents(spark, rows), block=block).collect()
    want = jaccard_links(rows)
    assert {r.doc_id: (r.n_links, r.component_id) for r in out if r.doc_id in want} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id not in want or want[r.doc_id][1] == r.doc_id) for r in out) and len(out) == len(rows)


def test_near_documents_odd_rows(spark):
    out = {r.doc_id: r for r in jaccard.near_documents(documents(spark, ODD)).collect()}
    assert out[1].kept and out[2].kept and out[None].kept and out[5].class_id == 5 == out[6].component_id and not out[6].kept and out[6].n_links == 1
    assert jaccard.near_documents(documents(spark, ODD).limit(0)).count() == 0


def test_pruning_keeps_likely_pairs():
    least = jaccard.least_matches()
    assert all(0 < m < 0.8 * n for n, m in least.items()) and list(least.values()) == sorted(least.values())


def test_overlaps_both_ways():
    rng = np.random.default_rng(0)
    a = [np.unique(rng.integers(0, 300, 80, dtype=np.uint64)) for _ in range(12)]
    i, j = np.nonzero(np.ones((12, 12)))
    assert (jaccard._overlaps(a, a, i, j) == [len(np.intersect1d(a[x], a[y])) for x, y in zip(i, j, strict=True)]).all()


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_license_rules_and_base_places(spark):
    assert len(licenses.rules()) > 300
    rows = [*ODD, (20, "The MIT  License; smith license. Apache\nLicense, Version 2.0"), (21, "GNU General Public License v3 or later. mit license mit license"), (22, "SPDX-License-Identifier: MIT")]
    out = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, rows), ["doc_id"]).withColumn("score", licenses.score()).collect()}
    assert [(b.at, b.label) for b in sorted(out[20].base)] == [(1, "mit"), (5, "apache")]
    assert {f.label for f in out[20].found} == {"mit", "apache-2.0"} and len(out[21].base) == 3
    assert {f.label for f in out[22].found} == {"mit"} and out[1].n_words == 0 and out[4].score == 0
    for r in rows:
        w = words(r[1])
        want = sorted((i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r[0] is None or sorted((b.at, b.label) for b in out[r[0]].base) == want


def samples(items):
    """Texts of a parsed pattern: each alternative and optional part once, beside the first of the others."""
    parser, out = re._parser, [""]
    for op, value in items:
        if op is parser.LITERAL:
            own = [chr(value)]
        elif op is parser.SUBPATTERN:
            own = samples(value[-1])
        elif op is parser.BRANCH:
            own = [x for branch in value[1] for x in samples(branch)]
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            own = ([""] if value[0] == 0 else []) + samples(value[2])
        elif op is parser.IN:
            kinds = {parser.CATEGORY_SPACE: " ", parser.CATEGORY_WORD: "w", parser.CATEGORY_NOT_SPACE: "x", parser.CATEGORY_NOT_WORD: ","}
            own = [next(x for k, v in value for x in ([chr(v)] if k is parser.LITERAL else [kinds[v]] if k is parser.CATEGORY else ["x"] if k is parser.NEGATE else []))]
        else:
            own = [""]
        out = [out[0] + x for x in own] + [x + own[0] for x in out[1:]]
    return out


def test_gates_drop_no_rule():
    """Scans behind the keywords equal scans by all rules, on a text for every alternative of every pattern."""
    s = licenses.Scanner()
    texts = {f"so {x} ." for r in s.rules for x in samples(re._parser.parse(r.pattern))}
    texts |= {"distributed under the terms of the 3-clause bsd", "the wtfpl", "beerware", "mit no attribution", "released under cc0", "see w3.org/consortium/legal", "the open rail license", "cc\u00a0by 4.0"}
    hit = set()
    for text in texts:
        every = [licenses.Detection(m.start(), m.end(), i) for i, c in enumerate(s.compiled) for m in c.finditer(text) if m.end() > m.start()]
        hit |= {d.rule for d in every}
        assert s.scan(text) == s.resolve(every), text
    assert hit == set(range(len(s.rules)))


def test_containment_and_priority():
    s = licenses.Scanner()
    text = "licensed under the gnu general public license, version 3."
    assert [s.rules[d.rule].label for d in s.scan(text)] == ["gpl-3.0"]
    a, b = licenses.Detection(0, 10, 3), licenses.Detection(2, 5, 3)
    assert s.resolve([b, a]) == [a]
    rng = random.Random(4)
    for _ in range(200):
        found = [licenses.Detection(i, i + rng.randint(1, 6), rng.randrange(len(s.rules))) for i in (rng.randrange(12) for _ in range(12))]
        rank = lambda d: (-s.rules[d.rule].priority, d.start - d.end, d.rule)
        inside = lambda d, k: k.start <= d.start and d.end <= k.end and rank(k) < rank(d)
        want = sorted({d for d in found if not any(inside(d, k) for k in found)})
        assert s.resolve(sorted(set(found))) == want


def test_words_of_license_texts(spark):
    s = licenses.Scanner()
    of = lambda text: {s.rules[d.rule].label for d in s.scan(text)}
    assert of("permission is hereby granted, free of charge,\nto any person obtaining a copy of this") == {"mit"}
    assert of("redistribution and use in source and binary forms, with or without\n// modification, are permitted") == {"bsd"}
    assert of("permission is hereby granted by the museum, free of charge") == set()


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), ["a", "b", "c", None][min(3, int(rng.random() ** 2 * 4))]) for i in range(800)] + [(None, "one two", "b"), (5000, None, "a"), (5001, "", "zero")]
    out = mixing.mix(documents(spark, rows), ["doc_id", "source"], ranges=16).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    assert sum({s: v[0].target for s, v in by.items()}.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 15 and v[0].target <= 3 * v[0].source_size + 1e-6
        assert all(r.taken <= 3 * r.size for r in v) and max(r.epochs for r in v) - min(r.epochs for r in v) <= 1
    again = mixing.mix(documents(spark, rows[::-1]), ["doc_id", "source"], ranges=7).collect()
    assert sorted((str(r.doc_id), r.taken) for r in out) == sorted((str(r.doc_id), r.taken) for r in again)


def test_targets_fill_like_water(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 20), (True, "", 0)], "s_null boolean, s_key string, source_size long")
    got = {r.s_key: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 30.0, "c": 60.0, "b": 940.0, "": 0.0}


def test_heavier_documents_come_first(spark):
    df = spark.range(4000).selectExpr("id", "IF(id % 2 = 0, 4.0, 1.0) AS w").withColumn("k", mixing.exponential_key(F.col("id"), F.col("w"), 0))
    first = df.orderBy("k").limit(1000).where("w = 4").count()
    assert 740 < first < 860


def test_no_range_of_mixing_keys_is_large(spark):
    """Whatever weights prevail: a range holds no more than twice the number of rates times an even part."""
    assert mixing._rates(1.0, 1.0) == [1.0] and mixing._rates(0.25, 1.0) == [1.0, 0.5, 0.25] and mixing._rates(0.3, 1.0)[-1] == 0.25
    wide = mixing._rates(1e-300, 1e300)
    assert len(wide) == 64 and wide[-1] <= 1e-300
    n, ranges = 100_000, 256
    for w in (0.25, 0.4, 1.0):
        keys = spark.range(n).select(mixing.exponential_key(F.col("id"), F.lit(w), 0).alias("k"))
        sizes = [r["count"] for r in keys.groupBy(mixing.key_range(F.col("k"), [1.0, 0.5, 0.25], ranges).alias("r")).count().collect()]
        assert max(sizes) < 2 * 3 / ranges * n
    order = spark.range(2000).select(mixing.exponential_key(F.col("id"), F.lit(0.25), 0).alias("k")).withColumn("r", mixing.key_range(F.col("k"), [1.0, 0.25], 64)).orderBy("k").collect()
    assert [x.r for x in order] == sorted(x.r for x in order)


def test_mixing_with_odd_weights(spark):
    """Weights that are null, zero, negative, infinite or no number crash nothing; results do not depend on the ranges."""
    odd = spark.createDataFrame([(1, None), (2, 0.0), (3, -1.0), (4, float("inf")), (5, float("nan")), (6, 1e-9), (7, 1e9)], "__key long, __weight double")
    docs = spark.range(1, 40).selectExpr("id AS doc_id", "'s' || id % 3 AS source", "repeat('w ', CAST(id % 7 AS int)) AS text")
    a, b = (sorted(map(tuple, mixing.mix(docs, ["doc_id"], weights=odd, ranges=k).collect())) for k in (1, 64))
    assert a == b and len(a) == 39


def test_mixing_nothing(spark):
    assert mixing.mix(documents(spark, ODD).limit(0), ["doc_id"]).count() == 0
    assert mixing.mix(documents(spark, ODD), ["doc_id"]).count() == len(ODD)


# --- 9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [400, 16])
def test_forest_recall(spark, leaf):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((60, 64))
    rows = [(i, [float(x) for x in centres[i % 60] + 0.15 * rng.standard_normal(64)], i % 2 if i % 11 else None) for i in range(600)]
    rows += [(700, [0.0] * 64, 1), (701, None, 1), (702, [float("nan")] * 64, 1), (703, [1.0], 1), (704, rows[1][1], 1), (705, [float("inf")] * 64, 0), (None, rows[1][1], 1), (706, [], 1)]
    out = {r.vec_id: r for r in forest.near_vectors(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int"), leaf=leaf).collect()}
    good = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if y is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and any(v) and i is not None]
    true = {(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93}
    count = dict.fromkeys(out, 0)
    for a, b in true:
        count[a] += 1
        count[b] += 1
    assert sum(r.n_links for r in out.values()) >= 0.99 * 2 * len(true) > 500
    assert all(out[i].n_links <= count[i] for i in out) and all(out[i].n_links == 0 and out[i].kept for i in (700, 701, 702, 703, 705, 706, None))


def test_vectors_of_rare_widths_and_doubles_link(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 0) for i in range(60)]
    rows += [(100, [1.0, 2.0, 3.0], 0), (101, [1.0, 2.0, 3.0 + 1e-12], 0), (102, [1.0, 2.0, 3.0] + [0.0] * 5, 0), (103, [1e200, 2e200, 3e200], 0), (104, [1.0, 2.0], 0)]
    out = {r.vec_id: r for r in forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=8).collect()}
    assert [out[i].n_links for i in (100, 101, 103)] == [2, 2, 2] and out[103].component_id == 100 and out[104].n_links == 0 and out[102].component_id != 100


def test_forest_of_nothing(spark):
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200), (300, 41)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and 200 not in got and got[300] == 41


def test_blocks_cover_all_pairs(spark):
    members = spark.range(50).selectExpr("id", "IF(id < 40, 0, id) AS g")
    cut = components.in_blocks(members, ["g"], "id", 10).collect()
    met = set()
    for _, rows in itertools.groupby(sorted(cut, key=lambda r: (r.g, r.lo, r.hi)), key=lambda r: (r.g, r.lo, r.hi)):
        rows = list(rows)
        met |= {(min(a.id, b.id), max(a.id, b.id)) for a in rows for b in rows if a.id != b.id and a.part == rows[0].lo and b.part == rows[0].hi}
    assert met == set(itertools.combinations(range(40), 2))


# --- 10 --------------------------------------------------------------------------------------------------------------


def base_by_pattern(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TRICKY = [
    "é a@b.c x", "a@b@c.d.e", "a@b.c@d.e", "@x.y a@.b a..b@c-d.e-f.", "1.2.3.4.5 300.1.1.1 001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (578) 555-6437 and +1234 +12345678901234567",
    "x" * 200 + "@y.z", "ü+49 30 1234567.", "4918187128635271", "a@b.c" * 50,
]


def test_base_spans_like_the_patterns(spark):
    rng = random.Random(9)
    noise = ["".join(rng.choice("ab1 .@+-(é9)%") for _ in range(60)) for _ in range(400)]
    for t in TRICKY + noise:
        raw = t.encode()
        got = [(len(raw[:s].decode()), k, len(raw[:e].decode())) for s, e, k in sanitise.base_spans(raw)]
        assert sorted(got) == base_by_pattern(t), t


def test_long_runs_and_bytes_that_are_no_text():
    text = b" ".join([b"a" * 100_000] * 20) + b"@" + b"b" * 1000 + b"@x.yz"
    assert sanitise.base_spans(text)[0][:2] == (len(text) - 1005, len(text)) and list(sanitise._emails(b"\xff a@b.c \xfe")) == [(2, 7)]


def test_terms_beside_entities(spark, prose):
    rows = [(1000 + i, f"{prose(30)} quixote writes to boss@corp.example here {prose(30)}") for i in range(4)] + [(100 + i, prose(60)) for i in range(60)] + [(200 + i, t) for i, t in enumerate(TRICKY)]
    out = {r.doc_id: r for r in sanitise.sanitise(documents(spark, rows + ODD), ["doc_id", "row"]).collect()}
    for i in range(4):
        r = out[1000 + i]
        kinds = {rows[i][1][s.start : s.end]: s.kind for s in r.spans}
        assert kinds["quixote"] == "term" and kinds["boss@corp.example"] == "email" and "quixote" not in r.sanitised
    assert all(not out[100 + i].spans for i in range(60)) and out[1].spans == out[2].spans == []
    for i, t in enumerate(TRICKY):
        assert [(s.start, sanitise.KINDS.index(s.kind), s.end) for s in out[200 + i].spans if s.kind != "term"] == base_by_pattern(t)
    assert sanitise.sanitise(documents(spark, ODD).limit(0), ["doc_id"]).count() == 0


def test_terms_far_from_entities_and_elsewhere(spark, prose):
    """Words at any distance, with digits and short, are counted with an entity, and go wherever they stand."""
    rows = [(i, f"anna77 {prose(40)} boss@corp.example {prose(40)} 48213 then anna77 or zq") for i in range(4)] + [(10, f"{prose(20)} anna77 was 48213 or Zq")] + [(100 + i, f"{prose(60)} then was or") for i in range(80)]
    out = {r.doc_id: r for r in sanitise.sanitise(documents(spark, rows), ["doc_id"]).collect()}
    for i in (0, 1, 2, 3, 10):
        assert not {"anna77", "48213", "zq"} & set(out[i].sanitised.lower().split()) and "or" in out[i].sanitised.split()
        assert [s.kind for s in out[i].spans].count("term") == (3 if i == 10 else 4)
    assert all(out[100 + i].sanitised == rows[5 + i][1] for i in range(80))


def test_generalised_terms_name_the_kind(spark, prose):
    rows = [(i, f"{prose(20)} quixote boss@corp.example") for i in range(8)] + [(20 + i, f"quixote {prose(20)}") for i in range(3)] + [(100 + i, prose(30)) for i in range(90)]
    out = {r.doc_id: r for r in sanitise.sanitise(documents(spark, rows), ["doc_id"], remove_from=0.99).collect()}
    assert all("[TERM OF EMAIL]" in out[i].sanitised and "quixote" not in out[i].sanitised for i in (0, 7, 20, 22)) and not out[100].spans


# --- queries ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """The first rows of no table: a fixture of its own, with copies and clashes."""
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    vocabulary = ["kalo", "mine", "ruta", "vo", "neka", "lomi", "tavo"]

    def text(n):
        return " ".join(rng.choice(vocabulary) + str(rng.randint(0, 60)) for _ in range(n))

    bench = [(i, text(20)) for i in range(4)]
    def shouted(n):
        return " ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(n))

    # of every five documents the first is bad, in its words and by its label
    docs = [(i, (shouted if i % 5 == 0 else text)(rng.randint(30, 80)) + "\n" + (shouted if i % 5 == 0 else text)(20), "en", f"src{i % 3}", 0) for i in range(60)]
    docs += [(60 + i, docs[i][1], "en", "src0", 0) for i in range(6)] + [(70 + i, bench[i][1] + " mit license a@b.cd", "en", None, 0) for i in range(4)] + [(80, None, "en", "src9", 0), (81, "", "en", "src1", 0)]
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(50)]
    pages = [(i, f"u{i}", text(10) if i % 4 else "same") for i in range(12)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 2) for i in range(30)]
    con = duckdb.connect()
    for name, rows, schema in (
        ("documents", docs, "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"), ("benchmark", bench, "item_id BIGINT, text VARCHAR"), ("labels", labels, "doc_id BIGINT, quality INTEGER, toxic INTEGER"),
        ("pages", pages, "page_id BIGINT, url VARCHAR, html VARCHAR"), ("embeddings", vectors, "vec_id BIGINT, embedding FLOAT[], label INTEGER"),
    ):
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d), con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_and_match_their_sql(spark, small, name):
    d, con = small
    df = Q.QUERIES[name](spark, d)
    got = df.collect()
    assert got and df.columns[0] in ("doc_id", "page_id", "vec_id")
    if name in Q.ORACLE:
        rel = con.sql(Q.ORACLE[name])
        rows = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]

        def plain(r, c):
            return [f"{r[x]:.9g}" if isinstance(r[x], float) else str(r[x]) for x in c]

        columns = sorted(df.columns)
        assert columns == sorted(rel.columns) and sorted(plain(r, columns) for r in got) == sorted(plain(r, columns) for r in rows)


def test_op10_digest(spark, small):
    d, con = small
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in Q.QUERIES["op10_sanitisation"](spark, d).collect():
        spans = base_by_pattern(texts[r.doc_id])
        joined = ",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.n_email == sum(k == 0 for _, k, _ in spans)


def test_pipeline(spark, small):
    import corpus_pipeline

    d, _ = small
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, d), "stage")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name.startswith("mixing") or docs.columns == columns
    good = {i for i in range(60) if i % 5}
    # bad documents and their copies go, then copies of good ones, whose lines all stand before, then those with benchmark passages
    assert seen[0] == good | {61, 62, 63, 64, 70, 71, 72, 73, 80, 81}
    assert seen[1] == seen[2] == good | {70, 71, 72, 73, 80, 81}
    assert seen[3] == good | {80, 81}
    assert seen[4] <= seen[3] and {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == seen[4]


def test_pipeline_stages_on_odd_tables(spark, small):
    """Extra columns of clashing names keep their values; empty tables stay empty."""
    import corpus_pipeline

    d, _ = small
    clashing = {c: F.lit(-1) for c in ("row", "n_dropped", "n_hit", "n_words", "items", "selected", "key", "range", "id", "kept")}
    full = spark.read.parquet(f"{d}/documents.parquet").withColumns(clashing)
    empty = full.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        full = corpus_pipeline.stored(stage(spark, full, d), "stage")
        assert full.where(" OR ".join(f"{c} <> -1" for c in clashing)).count() == 0 and full.count() > 0
        assert stage(spark, empty, d).count() == 0
