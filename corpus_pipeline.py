"""From documents to packed training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.llm import decontamination, jaccard, language, packing, quality_rules
from framewright.llm.common import cut, few

#: run()'s rows can't be had by SQL: language model, packing order. tests/llm has a brute-force version of what stays.
ORACLE_SQL = None

#: Hashes of so many contaminated texts at most, 16 bytes each, are broadcast; more are joined by shuffling.
BROADCAST_TEXTS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: texts that are null or without a letter, and texts that are far less
    likely than usual in every language that labelled documents have. Rows are judged one by one, so repeated rows and null ids
    fare alike. Where no row has a language, every text goes as undetermined; an empty table gives none."""
    predict = language.predictor(docs, language.fit(docs))
    told = docs.select(F.struct(*docs.columns).alias("row"), predict("text").alias("p"))
    return told.where((F.col("p.lang_pred") != language.UNDETERMINED) & ~F.col("p.foreign")).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the base rules and the limits of their language and source let pass. Null texts go; null
    languages and sources are groups of their own; repeated rows and ids are judged by their own text; an empty table gives none."""
    return quality_rules.passing(docs)


def _hashed(docs: DataFrame) -> DataFrame:
    """Each row whole, in one column, beside its text and the text's hashes: no column of docs can clash with them."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("hash"), F.md5("text").alias("digest"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets with a similarity of 0.8 or more: the text with the
    smallest hash, and of rows with that text the one with the smallest id, null ids last. Texts without words all stay, null
    ones too; an empty table gives none. Texts are told apart by 64 and 128 bits: of two with one 64-bit hash both stay."""
    hashed = _hashed(docs)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = jaccard.JaccardJoin(5, 4, 5).classes(hashed.where(worded), key="hash")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("hash")).distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "number")
    once = hashed.where(worded).withColumn("number", F.monotonically_increasing_id()).groupBy("hash", "digest").agg(F.min_by("row", order).alias("row"))
    return once.join(first, "hash", "left_semi").select("row.*").unionByName(hashed.where(~worded).select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an item of the benchmark is found, by their text, so that null and repeated ids make no
    difference. Null and empty texts stay; without items everything stays; an empty table gives none."""
    hashed = _hashed(docs)
    hits = decontamination.contaminated(hashed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="hash").select(F.col("doc_id").alias("hash")).distinct()
    return hashed.join(few(cut(hits, "hits"), BROADCAST_TEXTS), "hash", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; null and empty texts are one end id, repeated rows are packed each, an empty table gives none."""
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table of documents; each stage's docstring tells what odd rows give."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
