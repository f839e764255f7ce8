"""The thin queries that bind the operators to the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, forest, jaccard, licenses, lines, mixing, resample, sanitise, suffixes, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])


def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, listed = warc.write_archives(_table(spark, sf_dir, "pages"))
    out = warc.reassembled(warc.read_records(spark, folder, listed))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"], train=~_held_out())
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("deduplicated", 256).alias("text_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"), ["doc_id"])
    at = F.col("base.at")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        licenses.joined_labels(F.col("base.label")).alias("base_labels"),
        licenses.joined_labels(F.concat(F.col("base.label"), F.col("found.label"))).alias("labels"),
        licenses.score().alias("score"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), ["doc_id"], weights=mixing.label_weight(_table(spark, sf_dir, "labels")))


def op9_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.sanitise(_table(spark, sf_dir, "documents"), ["doc_id"])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint) AS n_{k}") for k in sanitise.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), ["doc_id"])


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_substrings(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), ["vec_id"])


QUERIES: dict[str, Query] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_warc_reassembly": op2_warc_reassembly,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_source_mixing": op8_source_mixing,
    "op9_embedding_neighbours": op9_embedding_neighbours,
    "op10_sanitisation": op10_sanitisation,
    "op11_token_alignment": op11_token_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_warc_reassembly": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, hex,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, CAST(5 * g + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * g + 2 AS BIGINT), 1) AS INT)
    + 4 * CAST(substr(bits, CAST(5 * g + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * g + 4 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(5 * g + 5 AS BIGINT), 1) AS INT), 1)), '') AS payload_digest FROM b),
m AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM m""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, (SELECT DISTINCT k FROM iw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
m AS (SELECT doc_id, i, k, item FROM dw JOIN iw USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_source_mixing": r"""
WITH k AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 END) AS w FROM labels GROUP BY 1),
d AS (SELECT documents.doc_id, source IS NULL AS s_null, coalesce(source, '') AS s_key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5('0|' || coalesce(CAST(documents.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / CAST(coalesce(w, 0.75) AS DOUBLE) AS key
  FROM documents LEFT JOIN k USING (doc_id)),
s AS (SELECT s_null, s_key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY s_null, s_key) - 1) % 3 AS DOUBLE) AS weight, 3.0 * source_size AS cap FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, s_null, s_key) AS place FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM p),
f AS (SELECT *, min(CASE WHEN CAST(cap AS DOUBLE) / weight > level THEN place END) OVER () AS first FROM l),
t AS (SELECT *, CASE WHEN first IS NULL OR place < first THEN CAST(cap AS DOUBLE) ELSE least(weight * max(CASE WHEN place = first THEN level END) OVER (), CAST(cap AS DOUBLE)) END AS target FROM f),
b AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.s_null, d.s_key ORDER BY key, CAST(doc_id AS VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.s_null = t.s_null AND d.s_key = t.s_key),
e AS (SELECT *, target - whole * source_size AS rest FROM b),
g AS (SELECT *, whole + CASE WHEN 2 * before + size <= 2 * rest AND rest > 0 THEN 1 ELSE 0 END AS epochs FROM e)
SELECT doc_id, size, source_size, target, epochs, size * epochs AS taken FROM g""",
    "op9_embedding_neighbours": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
}
