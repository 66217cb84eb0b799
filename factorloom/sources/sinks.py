"""Sinks and loads: replace by date, incremental loads, checks of loads, and payload manifests; versions are in commits.py."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, else the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new shared folder, and read again: a table that later jobs use several times."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_dates(rows: DataFrame, path: str, date: str) -> None:
    """Write rows so that the dates they have replace those at path; other dates stay. Writing the same rows again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def load_once(old: DataFrame, loaded: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old with the first loaded row of each key; loading twice gives the same."""
    return R.upsert(old, R.latest(loaded, keys, order), keys)


def incremental(source: DataFrame, target: DataFrame, key: str, date: str, overlap_days: int) -> DataFrame:
    """target brought up to source: dates from the last one less the overlap are read again, and keys that the target has only later than the source are filled back."""
    cutoff = target.agg(F.date_sub(F.max(date), overlap_days).alias("_cut"))
    old = target.join(F.broadcast(cutoff)).where(F.col(date) < F.col("_cut")).drop("_cut")
    new = source.join(F.broadcast(cutoff)).where(F.col("_cut").isNull() | (F.col(date) >= F.col("_cut"))).drop("_cut")
    first = lambda df, name: df.groupBy(F.col(key).alias("_key")).agg(F.min(date).alias(name))
    late = first(source, "_s").join(first(target, "_t"), "_key").where(F.col("_s") < F.col("_t"))
    back = source.join(late, F.col(key) == F.col("_key")).join(F.broadcast(cutoff)).where((F.col(date) < F.col("_t")) & (F.col(date) < F.col("_cut"))).select(*source.columns)
    return old.unionByName(new).unionByName(back)


def load_counts(before: DataFrame, deleted: DataFrame, loaded: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows each has, and whether before less deleted plus loaded is after."""
    out = None
    for name, df in (("before", before), ("deleted", deleted), ("loaded", loaded), ("after", after)):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.withColumn("ok", F.col("before") - F.col("deleted") + F.col("loaded") == F.col("after"))


def from_last(rows: DataFrame, saved: DataFrame, date: str, *, old_method: str | None, new_method: str) -> DataFrame:
    """The rows to persist: those after the last saved date, or all if the method has changed or nothing is saved."""
    if old_method != new_method:
        return rows
    last = saved.agg(F.max(date).alias("_last"))
    return rows.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).drop("_last")


def manifest(payloads: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(name, hash): the hash of a payload's fields as JSON, in the order given."""
    return payloads.select(name, F.sha2(F.to_json(F.struct(*fields)), 256).alias("hash"))


def compared_manifests(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(name, status): same, changed, missing or extra."""
    both = expected.select(name, F.col("hash").alias("_e")).join(found.select(name, F.col("hash").alias("_f")), name, "full_outer")
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e") == F.col("_f"), "same").otherwise("changed")
    return both.select(name, status.alias("status"))


def retained(rows: DataFrame, date: str, as_of: Column, keep_years: int) -> DataFrame:
    """Rows no older than keep_years times 365 days."""
    return rows.where(F.col(date) >= F.date_sub(as_of, 365 * keep_years))


def sessions_only(rows: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """Rows dated on a session of the calendar (a column of that name)."""
    return rows.join(calendar.select(date).distinct(), date, "left_semi")


def signature(rows: DataFrame, key: str, date: str) -> DataFrame:
    """One row: the last date and the number of keys, by which a cache of latest rows knows that it is out of date."""
    return rows.agg(F.concat_ws("|", F.max(date).cast("string"), F.count_distinct(key).cast("string")).alias("signature"))


def picked(df: DataFrame, names: list[str], out: str) -> DataFrame:
    """df with out: the first value that isn't null of those columns of names that it has; null if it has none."""
    here = [F.col(n) for n in names if n in df.columns]
    return df.withColumn(out, F.coalesce(*here) if here else F.lit(None).cast("string"))


def fiscal_period(text: Column) -> Column:
    """(year, quarter) of texts such as FY2024Q3, Q3 2024 or 2024; quarter is null for years."""
    year = F.nullif(F.regexp_extract(text, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")
    quarter = F.nullif(F.regexp_extract(F.upper(text), r"Q([1-4])", 1), F.lit("")).cast("int")
    return F.struct(year.alias("year"), quarter.alias("quarter"))


def parsed_holdings(rows: DataFrame, registry: DataFrame, tickers: DataFrame) -> DataFrame:
    """rows with ric, qty and reason, null where a row is accepted.

    rows: (row_number, account, quantity, ric, ticker), all text but the number; registry: (ric); tickers: (ticker, resolved),
    one security a ticker. Reasons are looked for in a fixed order; of accepted rows with one account and ric the first stays.
    """
    given = rows.withColumns({"_account": F.trim("account"), "_ric": F.upper(F.trim(F.coalesce("ric", F.lit("")))), "_ticker": F.upper(F.trim(F.coalesce("ticker", F.lit("")))), "qty": F.expr("try_cast(trim(quantity) AS DOUBLE)")})
    known = registry.select(F.upper("ric").alias("_ric"), F.lit(True).alias("_known")).distinct()
    names = tickers.select(F.upper("ticker").alias("_ticker"), "resolved")
    met = given.join(known, "_ric", "left").join(names, "_ticker", "left")
    valid = F.col("_account").rlike(r"\A[A-Za-z0-9_\-]+\z")
    reason = (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid_account_id")
        .when(F.col("qty").isNull() | F.isnan("qty") | (F.abs("qty") == float("inf")), "invalid_quantity")
        .when((F.col("_ric") != "") & F.col("_known").isNull(), "unknown_ric")
        .when((F.col("_ric") == "") & (F.col("_ticker") == ""), "missing_identifier")
        .when((F.col("_ric") == "") & F.col("resolved").isNull(), "unknown_ticker")
    )
    met = met.withColumns({"reason": reason, "ric": F.when(reason.isNull(), F.when(F.col("_ric") != "", F.col("_ric")).otherwise(F.col("resolved")))})
    w = Window.partitionBy("_account", "ric", F.col("reason").isNull()).orderBy("row_number")
    again = F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "duplicate_row_in_file").otherwise(F.col("reason"))
    return met.select("row_number", F.col("_account").alias("account"), "ric", "qty", again.alias("reason"))
