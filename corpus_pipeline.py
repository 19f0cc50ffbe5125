"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes
it and reads it back as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, language_id, near_dedup, packing, secrets
from loomline.llm.membership import among, without
from loomline.llm.queries import TOKENIZER
from loomline.llm.shared import save
from loomline.plans.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents at hand are labelled with.

    The nearest profile's score decides: texts far from every profile go, as do null
    and empty texts and those without a letter.  Rows that repeat stay or go each.
    """
    ship(spark)
    return language_id.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Rows that share a doc_id are one document, of which the row that sorts first by
    text (null last), then by all of its columns, stays; rows without a doc_id cannot be told
    apart from their copies and stay.  Null and empty texts are no copies.
    """
    ship(spark)
    told = near_dedup.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows"), F.bool_or("kept").alias("_kept"))
    # Most documents stay as they are: those that do not are looked up, and no other text is moved.
    told = save(told.filter("_rows > 1 or not _kept"), "told")
    out = without(docs, told.select("doc_id"), "doc_id")
    several = told.filter("_kept").select("doc_id")
    if several.isEmpty():
        return out
    row = F.struct(*docs.columns)
    first = among(docs, several, "doc_id").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), "text", F.to_json(row))).alias("_row"))
    return out.unionAll(first.select("_row.*"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or edited, whole or a passage of 13 words.

    Null and empty texts hold none; rows that repeat stay or go each.
    """
    ship(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked in the text.

    Null and empty texts stay as they are; rows that repeat stay, each masked.
    """
    ship(spark)
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null text is
    its end id alone, rows that repeat are packed each."""
    ship(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Signatures, alignments and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
