"""Audits of tables: parity of two copies, duplicate keys, period health, what is known of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def crowded_periods(rows: DataFrame, key: str, date: str, period: str = "month") -> DataFrame:
    """(key, period, anchors): periods in which a key has rows of more than one date."""
    return rows.groupBy(key, F.trunc(date, period).alias("period")).agg(F.count_distinct(date).alias("anchors")).where(F.col("anchors") > 1)


def profile(rows: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """One row: row count, first and last date, ids on the last date, and non-null counts; a single aggregation over counts by date."""
    by_date = rows.groupBy(date).agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), *[F.count(v).alias(v) for v in values])
    return by_date.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_n"), F.min(date).alias("first"), F.max(date).alias("last"), F.max_by("ids", date).alias("last_ids"), *[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v}_n") for v in values])


def parity_issues(left: DataFrame, right: DataFrame, key: str, date: str, values: list[str]) -> DataFrame:
    """(issue, left_value, right_value): figures of two copies that differ, as text."""
    figures = ["row_n", "first", "last", "last_ids", *[f"{v}_n" for v in values]]

    def long(df: DataFrame, side: str) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("issue"), F.col(f).cast("string").alias(side)) for f in figures])).alias("c")
        return profile(df, key, date, values).select(cells).select("c.*")

    return long(left, "left_value").join(long(right, "right_value"), "issue").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def observations(ids: DataFrame, sources: dict[str, DataFrame], key: str = "ric") -> DataFrame:
    """ids with latest_<source> (date) and has_<source>, and ready where all sources have rows. sources: DataFrames of (key, date)."""
    out = ids
    for name, rows in sources.items():
        latest = rows.groupBy(key).agg(F.max("date").alias(f"latest_{name}"))
        out = out.join(latest, key, "left").withColumn(f"has_{name}", F.col(f"latest_{name}").isNotNull())
    ready = F.lit(True)
    for name in sources:
        ready = ready & F.col(f"has_{name}")
    return out.withColumn("ready", ready)
