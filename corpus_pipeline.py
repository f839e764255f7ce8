"""A corpus pipeline of five stages: quality, lines, near-duplicates, benchmarks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.llm import decontaminate, jaccard, lines, mixing, resample
from aeolith.llm.components import parted
from aeolith.llm.storage import drop, stored

#: SQL can express neither the hashed models nor the MinHash and SimHash searches.
ORACLE_SQL = None


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and all but the text as ``__doc``: extra columns keep their values whatever their names."""
    return docs.select("doc_id", "text", "source", F.struct(*[c for c in docs.columns if c != "text"]).alias("__doc"))


_KEPT = ["__doc", "text"]


def _unpacked(out: DataFrame, columns: list[str], *added: str) -> DataFrame:
    return out.select(*[F.col("text") if c == "text" else F.col("__doc")[c].alias(c) for c in columns if c not in added], *added)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; null and empty texts weigh 1.  Repeated rows stay or go together."""
    out = resample.importance_resampling(_packed(docs), _read(spark, sf_dir, "labels"), _KEPT)
    return _unpacked(out.where("selected"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses its last words goes.  Null and empty texts stay as they are."""
    out = lines.dedup_lines(_packed(docs), ["__doc"])
    out = out.where((F.col("n_dropped") == 0) | (lines.normalised(F.col("deduplicated")) != ""))
    text = F.col("deduplicated")
    n_chars = F.when(F.col("n_dropped") == 0, F.col("__doc.n_chars")).otherwise(F.length(text).cast("long"))
    new = {"text": text, "n_chars": n_chars}
    return out.select(*[(new[c] if c in new else F.col("__doc")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; texts without words and rows without id stay, as do all rows of an id that stays."""
    gone = stored(jaccard.near_documents(docs).where("NOT kept").select(F.col("doc_id").alias("__id")).distinct(), "near-duplicates")
    # texts of documents that surely stay are not shuffled
    maybe, stay = parted(gone, "__id", docs, F.col("doc_id"))
    return maybe.join(gone.hint("merge"), F.col("doc_id") == F.col("__id"), "left_anti").select(docs.columns).unionByName(stay)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate; a text without words is clean."""
    out = decontaminate.contamination(_packed(docs), _read(spark, sf_dir, "benchmark"), _KEPT)
    return _unpacked(out.where(~decontaminate.is_contaminated()), docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, epochs (times taken) and taken; extra columns of these names go."""
    weights = mixing.label_weight(_read(spark, sf_dir, "labels"))
    out = mixing.mix(_packed(docs), _KEPT, weights=weights).where("epochs > 0")
    return _unpacked(out, docs.columns, "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the table of each stage is deleted once the next is written."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(docs)
        docs = kept
    return docs
