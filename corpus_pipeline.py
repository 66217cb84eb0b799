"""A corpus pipeline: each stage calls an operator of factorloom.llm over all rows that the stage before kept.

Stages but the last return the columns of documents. Rows whose id is null pass through near deduplication;
of rows that share an id one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from factorloom.llm.common import checkpointed, table, written

#: Ids that are broadcast at most.
FEW_IDS = 1_000_000


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The text, the columns named, and all others in a struct, so that what an operator adds clashes with none of them."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text", *columns)


def unwrapped(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """rows with the columns of docs: the text as it is now, columns that changed, and the others from the struct."""
    return rows.select(*[changed.get(c, F.col("text" if c == "text" else f"_row.`{c}`")).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return unwrapped(quality_rules.judge(wrapped(docs, "lang", "source")).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines; n_chars follows the text."""
    rows = line_dedup.drop_lines(wrapped(docs, "doc_id"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unwrapped(rows, docs, n_chars=n_chars)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, one row of each id: one with a text if there is, then by the hash of the text."""
    gone = checkpointed(near_dedup.dedup(docs).where(~F.col("kept")).select("doc_id").distinct())
    if gone.count() <= FEW_IDS:
        gone = F.broadcast(gone)
    # Joined by name, so other columns of docs may have any names.
    kept = docs.join(gone, "doc_id", "left_anti")
    again = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    few = again.count()
    if not few:
        return kept
    if few <= FEW_IDS:
        again = F.broadcast(again)
    same = "doc_id"
    first = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("of"), F.struct(*docs.columns).alias("row")))
    repeated = kept.join(again, same, "left_semi").groupBy("doc_id").agg(first.alias("first")).select("first.row.*")
    return kept.join(again, same, "left_anti").unionByName(repeated)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and what they decode to."""
    return bpe.encode(docs, bpe.vocabulary_path()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", encoding_stage),
]

#: Near-duplicate groups and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = table(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4().hex}"
    for label, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{name}/{label}")
    return STAGES[-1][1](spark, docs, sf_dir)
