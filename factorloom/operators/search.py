"""Ranked substring search by an index of character trigrams, so that a term reads the rows of its rarest trigram only."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder

#: Folders that trigrams are dealt to; a lookup opens one.
BUCKETS = 64
#: Rows whose postings a task sorts and writes.
ROWS_OF_TASK = 50_000


def grams_of(term: str) -> list[str]:
    return sorted({term[i : i + 3] for i in range(len(term) - 2)})


def build_index(rows: DataFrame, columns: list[str]) -> str:
    """Write postings (rows under each trigram of their columns' capitals), counts of trigrams, and the rows themselves; the folder.

    Nulls and texts of less than three characters have no trigrams; such rows are found by shorter terms only.
    """
    root = shared_folder(rows.sparkSession, "index")
    rows.write.parquet(f"{root}/rows")
    # A file of few megabytes has millions of postings, so its rows are dealt out before they are exploded.
    rows = rows.sparkSession.read.parquet(f"{root}/rows")
    rows = rows.repartition(-(-rows.count() // ROWS_OF_TASK) or 1)
    text = [F.upper(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    pieces = lambda t: F.transform(F.when(F.char_length(t) >= 3, F.sequence(F.lit(1), F.char_length(t) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(t, i, F.lit(3)))
    postings = rows.withColumn("_gram", F.explode(F.array_distinct(F.concat(*map(pieces, text)))))
    postings = postings.withColumn("_bucket", (F.crc32(F.col("_gram").cast("binary")) % BUCKETS).cast("int"))
    # A frequent trigram's rows are spread over tasks; each file is in order, so its statistics tell which trigrams it has.
    postings.sortWithinPartitions("_bucket", "_gram").write.partitionBy("_bucket").parquet(f"{root}/postings")
    postings.groupBy("_gram").count().sort("_gram").write.parquet(f"{root}/counts")
    return root


def candidates(spark: SparkSession, root: str, term: str) -> DataFrame:
    """Rows that may hold a term: those under its rarest trigram; all rows for a term of less than three characters, none if a trigram is nowhere."""
    grams = grams_of(term.upper())
    if not grams:
        return spark.read.parquet(f"{root}/rows")
    counts = {r["_gram"]: r["count"] for r in spark.read.parquet(f"{root}/counts").where(F.col("_gram").isin(grams)).collect()}  # a row a trigram of the term
    rarest = min(grams, key=lambda g: (counts.get(g, 0), g))
    postings = spark.read.schema(spark.read.parquet(f"{root}/postings").schema).parquet(f"{root}/postings")
    return postings.where((F.col("_bucket") == zlib.crc32(rarest.encode()) % BUCKETS) & (F.col("_gram") == rarest)).drop("_gram", "_bucket")


def tier(ticker: str, name: str, term: str) -> Column:
    """0 for the whole ticker, 1 for its beginning, 2 for a part of it, 3 for a part of the name; else null."""
    t, key, text = term.upper(), F.upper(ticker), F.upper(name)
    return F.when(key == t, 0).when(key.startswith(t), 1).when(key.contains(t), 2).when(text.contains(t), 3)


def indexed_search(spark: SparkSession, root: str, ticker: str, name: str, term: str, limit: int) -> DataFrame:
    """What relational.ranked_search finds, from an index over both columns."""
    found = candidates(spark, root, term).withColumn("rank", tier(ticker, name, term)).where(F.col("rank").isNotNull())
    return found.orderBy("rank", ticker).limit(limit)
