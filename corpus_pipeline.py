"""The corpus pipeline: five stages, each of which calls one operator of millrace.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows to the shared folder as Parquet and reads them back as the next one's docs.
All stages but the last return the columns of documents. What they leave out:

1. language_id: documents whose language can't be told: null texts, texts without a
   letter, and texts for which no language reaches MIN_LANGUAGE_SCORE. It learns from the
   labelled rows of its own input.
2. near_duplicates: of each group of documents linked by shingle Jaccard, all but the one
   with the smallest id; among equal ids the one whose text has the smaller hash, and of equal
   rows one. Documents with empty sets stay.
3. decontaminate: documents that a benchmark item leaks into.
4. redact_pii: nothing; spans of personal data in the text become their kind in brackets,
   and n_chars is the new length.
5. encode: nothing; returns (doc_id, ids, decoded) with the end id.

Every stage decides row by row: rows with a null or shared doc_id are told apart by their
text. Null ids come last where the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate as leaks
from millrace.llm import jaccard_tiles, language_id, pii_bootstrap, sp_chunks
from millrace.llm.common import forget_staged, staged, staged_paths
from millrace.sources.tables import read_table

#: Above chance for any number of languages; clean texts of a few words reach it.
MIN_LANGUAGE_SCORE = 0.5
ROW = "__row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs)
    found = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    keep = (F.col("lang_pred") != language_id.UNDETERMINED) & (
        F.col("score") >= MIN_LANGUAGE_SCORE
    )
    return found.filter(keep).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("long")
    per_id = docs.groupBy("doc_id").count()
    if not per_id.filter(F.col("doc_id").isNull() | (F.col("count") > 1)).isEmpty():
        # Ids don't tell rows apart, so numbers in their order stand in for them.
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
        docs = staged(docs.orderBy(*order).withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    else:
        docs = docs.withColumn(ROW, number)
    groups = jaccard_tiles.near_duplicates(docs.select(F.col(ROW).alias("doc_id"), "text"))
    others = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(ROW))
    return docs.join(others, ROW, "left_anti").drop(ROW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii_bootstrap.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_chunks.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("encode", encode),
]

#: No SQL expresses language identification, bootstrapping or the tokenizer: the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = set(staged_paths())
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        # What a stage worked with goes once its rows are written.
        own = [path for path in staged_paths() if path not in before]
        forget_staged(spark, own[:-1])
    return docs
