"""Point-in-time joins, latest rows, keyed comparisons and grouped summaries. Each operator maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order; ties need an order that settles them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_wide(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the largest order by key, as an aggregate that combines before the shuffle; order and columns become columns."""
    best = F.max_by(F.struct(*order, *columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, order: list[str], columns: list[str]) -> DataFrame:
    """left with columns of right's last row of the same key dated at or before left_date, as whole rows.

    Both sides are sorted once by key and date and the last right row is carried forward: one shuffle, no range join. Rows
    of left are kept one by one, so repeated rows stay. order settles right rows of one date.
    """
    right_row = F.struct(F.col(right_date).alias(right_date), *order, *columns)
    sides = left.select(F.col(key).alias("_key"), F.col(left_date).alias("_date"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(right_row.alias("r")).schema["r"].dataType).alias("_right"))
    events = right.select(F.col(key).alias("_key"), F.col(right_date).alias("_date"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"), right_row.alias("_right"))
    w = Window.partitionBy("_key").orderBy("_date", "_side", *[F.col(f"_right.{c}") for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    carried = sides.unionByName(events).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select("_left.*", F.col(f"_right.{right_date}").alias(right_date), *[F.col(f"_right.{c}").alias(c) for c in columns])


def asof_fill(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, order: list[str], columns: list[str]) -> DataFrame:
    """As asof_backward, but each column's last value that isn't null, so columns can come from different rows."""
    kept = [F.col(c) for c in columns]
    kinds = {c: right.schema[c].dataType for c in columns}
    sides = left.select(F.col(key).alias("_key"), F.col(left_date).alias("_date"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), *[F.lit(None).cast("long").alias(f"_o{i}") for i in range(len(order))], *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    events = right.select(F.col(key).alias("_key"), F.col(right_date).alias("_date"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *kept)
    w = Window.partitionBy("_key").orderBy("_date", "_side", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    carried = sides.unionByName(events).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return carried.where("_side = 1").select("_left.*", *columns)


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after, delta) of the keys of either side; missing counts as 0."""
    a = before.groupBy(*keys).agg(F.sum(value).alias("before"))
    b = after.groupBy(*keys).agg(F.sum(value).alias("after"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, keys, "full_outer").select(*keys, zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"))


def value_mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys that are in one side only or whose values differ by more than the tolerance."""
    both = a.select(*keys, F.col(value).alias("left_value")).join(b.select(*keys, F.col(value).alias("right_value")), keys, "full_outer")
    same = F.col("left_value").isNotNull() & F.col("right_value").isNotNull() & (F.abs(F.col("left_value") - F.col("right_value")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, new ones replacing old; new has each key once."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti").select(*old.columns))


def upsert_keep_old(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both by key; a blank or null new text keeps the old one."""
    n, o = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns]), old.select(*keys, *columns)
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(F.nullif(F.col(f"_n_{c}"), F.lit("")), F.col(c)).alias(c) for c in columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def well_covered_date(df: DataFrame, date: str, least: int = 100, share: float = 0.5) -> DataFrame:
    """One row: the latest date with at least max(least, share of the largest day) rows, else the latest date."""
    days = df.groupBy(date).agg(F.count("*").alias("n"))
    top = days.agg(F.max("n").alias("most"), F.max(date).alias("last"))
    good = days.join(F.broadcast(top)).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("most") * share)))
    return top.join(F.broadcast(good.agg(F.max(date).alias("good")))).select(F.coalesce("good", "last").alias(date))


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) of equal bins from low to high, by default the 1st and 99th percentile; the last bin holds its right edge, values beyond are left out."""
    spark = df.sparkSession
    edges = df.agg(F.percentile(value, [0.01, 0.99]).alias("p")).select(*(F.lit(x) if x is not None else F.col("p")[i] for i, x in enumerate((low, high))))
    edges = edges.toDF("_low", "_high")
    inside = df.select(value).join(F.broadcast(edges)).where((F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high")))
    place = F.least(F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def longest_gap(df: DataFrame, keys: list[str], order: str, observed: str) -> DataFrame:
    """By key the longest run of rows, in order, that weren't observed."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = df.withColumn("_island", F.sum(F.col(observed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.groupBy(*keys, "_island").agg(F.sum((~F.col(observed)).cast("int")).alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").cast("long").alias("longest_gap"))


def ranked_search(df: DataFrame, ticker: str, name: str, term: str, limit: int) -> DataFrame:
    """Rows that match a term: exact ticker, ticker prefix, ticker part, name part; the best come first."""
    t, key, text = term.upper(), F.upper(ticker), F.upper(name)
    rank = F.when(key == t, 0).when(key.startswith(t), 1).when(key.contains(t), 2).when(text.contains(t), 3)
    return df.withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", ticker).limit(limit)
