"""Diagnostics of the model's health in five sections, from the tables of the daily job (jobs.py), a book and source tables.

Every section gives rows (section, part, name, other, date, place, x, value): name and other are factors, fields or measures, place and x
the number and the middle of a histogram's bin; what a part has no use for is null. Windows are over one row a date, or one a factor and date;
securities are only summed. Series of the first two sections are sampled at the last date of each week.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from . import portfolio as P
from . import relational as R
from . import riskmodel as M
from . import service as V
from . import timeseries as T

#: Weeks of the short and the long mean of a weekly series, and weeks these need.
SHORT, SHORT_LEAST, LONG, LONG_LEAST = 12, 4, 52, 8
#: Days of a rolling volatility, days it needs, days of a year, and days of the realised volatility.
VOL_DAYS, VOL_LEAST, YEAR, REALIZED_DAYS = 60, 20, 252.0, 60
#: Securities that a date's block R2 needs, and the coverage in percent below which it is low.
BLOCK_LEAST, LOW = 20, 80.0
#: Bins and bounds of the histogram of t-statistics, bins of exposures and of returns.
T_BINS, T_BOUND, EXPOSURE_BINS, RETURN_BINS = 48, 6.0, 30, 40

COLUMNS = {"name": "string", "other": "string", "date": "date", "place": "int", "x": "double", "value": "double"}


def part(df: DataFrame, section: int, label: str, /, **columns: Column) -> DataFrame:
    """Rows of one part of a section."""
    given = {c: F.lit(None) if columns.get(c) is None else columns[c] for c in COLUMNS}
    return df.select(F.lit(section).alias("section"), F.lit(label).alias("part"), *[v.cast(COLUMNS[c]).alias(c) for c, v in given.items()])


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def week_ends(rows: DataFrame, date: str = "date") -> DataFrame:
    """(date): the last date of each week from Saturday to Friday."""
    return rows.groupBy(T.week_friday(F.col(date), True).alias("_week")).agg(F.max(date).alias(date)).select(date)


def rolled(value: str, days: int, least: int) -> Column:
    """The mean of the last rows by date, and the value itself where there are fewer than least. For one row a date."""
    w = Window.orderBy("date").rowsBetween(1 - days, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w)).otherwise(F.col(value))


def histograms(rows: DataFrame, by: str, value: str, bins: int, bound: float | None = None) -> DataFrame:
    """(by, place, x, n): equal bins from -bound to bound, else from each group's 1st to 99th percentile; where both are equal, from 1 below to 1 above.

    The last bin holds its right edge, values beyond are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    edges = rows.groupBy(by).agg(F.percentile(value, [0.01, 0.99]).alias("p"))
    low, high = (F.col("p")[0], F.col("p")[1]) if bound is None else (F.lit(-bound), F.lit(bound))
    edges = edges.select(by, F.when(high > low, low).otherwise(low - 1).alias("_low"), F.when(high > low, high).otherwise(high + 1).alias("_high"))
    inside = rows.select(by, value).join(F.broadcast(edges), by).where(F.col(value).between(F.col("_low"), F.col("_high")))
    place = F.least(F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(by, place.alias("place")).agg(F.count("*").alias("n"))
    every = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("place"))
    x = F.col("_low") + (F.col("place") + 0.5) * (F.col("_high") - F.col("_low")) / bins
    return every.join(counts, [by, "place"], "left").select(by, "place", x.alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def block_r2(returns: DataFrame, residuals: DataFrame, styles: list[str], least: int = BLOCK_LEAST) -> DataFrame:
    """(date, r2_full, r2_structural, r2_style_incremental): the R2 without what styles explain, from residuals with root-cap weights.

    Dates of fewer than `least` residuals with a cap are left out. A style without a return explains nothing on that date.
    """
    legs = returns.groupBy("date").agg(F.avg("r_squared").alias("_r2"), *[F.coalesce(F.max(F.when(F.col("factor_name") == s, F.col("factor_return"))), F.lit(0.0)).alias(f"_b{i}") for i, s in enumerate(styles)])
    w, e = F.sqrt("cap"), F.col("residual")
    s = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) * F.col(f"_b{i}") for i, c in enumerate(styles)), e)
    rows = residuals.where((F.col("cap") > 0) & e.isNotNull() & (F.trim("industry") != "")).join(F.broadcast(legs), "date")
    sums = rows.groupBy("date").agg(F.count("*").alias("_n"), F.first("_r2").alias("r2_full"), F.sum(w * e * e).alias("_e"), F.sum(w * s * s).alias("_s")).where((F.col("_n") >= least) & F.col("r2_full").isNotNull())
    structural = F.when(F.col("_e") > 0, 1 - F.col("_s") * F.greatest(F.lit(1e-10), 1 - F.col("r2_full")) / F.col("_e")).otherwise(F.col("r2_full"))
    return sums.select("date", "r2_full", structural.alias("r2_structural")).withColumn("r2_style_incremental", F.col("r2_full") - F.col("r2_structural"))


def regression_section(returns: DataFrame, residuals: DataFrame, styles: list[str], by_category: DataFrame, specific: DataFrame) -> DataFrame:
    """R2 and block R2 by week, t-statistics, and how a book's variance splits. by_category, specific: of one account (P.category_variance, P.specific_variance)."""
    weeks = week_ends(returns)
    sampled = returns.join(F.broadcast(weeks), "date", "left_semi")
    r2 = sampled.groupBy("date").agg(F.avg("r_squared").alias("r2"))
    r2 = r2.withColumns({"roll60": rolled("r2", SHORT, SHORT_LEAST), "roll252": rolled("r2", LONG, LONG_LEAST)})
    block = block_r2(sampled, residuals.join(F.broadcast(weeks), "date", "left_semi"), styles)
    measures = [c for c in block.columns if c != "date"]
    block = block.withColumns({c.replace("r2", "roll60", 1): rolled(c, SHORT, SHORT_LEAST) for c in measures})
    is_style = F.col("factor_name").isin(styles)
    day = V.breadth(sampled, "date", is_style, "t_stat").fillna(0.0, ["style", "other"])
    whole = sampled.agg(*[F.coalesce(F.avg(F.when(c, F.abs("t_stat"))), F.lit(0.0)).alias(n) for c, n in ((is_style, "style"), (~is_style, "other"))])
    shares = P.risk_shares(by_category, specific)
    total = F.sum("variance").over(Window.partitionBy())  # three rows, one a category
    name, value, date = F.col("name"), F.col("value"), F.col("date")
    return together([
        part(r2.unpivot("date", ["r2", "roll60", "roll252"], "name", "value"), 1, "r2_series", name=name, date=date, value=value),
        part(block.unpivot("date", [c for c in block.columns if c != "date"], "name", "value"), 1, "block_r2_series", name=name, date=date, value=value),
        part(histograms(returns.withColumn("_all", F.lit("t_stat")), "_all", "t_stat", T_BINS, T_BOUND), 1, "t_stat_histogram", place=F.col("place"), x=F.col("x"), value=F.col("n")),
        part(V.hit_rate(returns, t="t_stat"), 1, "hit_rate", name=F.col("factor_name"), value=sql_round("hit_rate", 2)),
        part(day.unpivot("date", ["style", "other"], "name", "value"), 1, "breadth_series", name=name, date=date, value=value),
        part(whole.unpivot([], ["style", "other"], "name", "value"), 1, "breadth", name=name, value=value),
        part(shares, 1, "variance_split", name=F.col("category"), value=F.col("share")),
        part(by_category.select("category", F.when(total > 0, F.col("variance") / total * 100).otherwise(0.0).alias("v")), 1, "factor_variance_split", name=F.col("category"), value=F.col("v")),
    ])


def exposures_of(residuals: DataFrame, styles: list[str]) -> DataFrame:
    """(date, ric, factor_name, exposure): 1 to the industry, and scores to styles. Other industries are left out."""
    cell = lambda n, v: F.struct(n.alias("factor_name"), v.alias("exposure"))
    cells = F.array(cell(F.col("industry"), F.lit(1.0)), *[cell(F.lit(s), F.coalesce(F.col(f"`{s}`").cast("double"), F.lit(0.0))) for s in styles])
    return residuals.select("date", "ric", F.inline(cells))


def sparse_correlations(cells: DataFrame, key: str = "ric") -> DataFrame:
    """(factor_name, factor_name_2, correlation) over all keys of cells (key, factor_name, exposure), where what is missing is 0; 0 for constants.

    Products are of the factors that a key has, so a key with 15 of 50 factors gives 225 rows, not 2,500.
    """
    lists = cells.groupBy(key).agg(F.collect_list(F.struct("factor_name", "exposure")).alias("l"))  # one entry a factor
    pairs = lists.select("l", F.inline("l")).select("factor_name", "exposure", F.inline(F.transform("l", lambda c: F.struct(c["factor_name"].alias("factor_name_2"), c["exposure"].alias("_y")))))
    products = pairs.groupBy("factor_name", "factor_name_2").agg(F.sum(F.col("exposure") * F.col("_y")).alias("_xy"))
    sums = cells.groupBy("factor_name").agg(F.sum("exposure").alias("_x"), F.sum(F.col("exposure") ** 2).alias("_xx"))
    n = cells.agg(F.count_distinct(key).alias("_n"))
    second = sums.select(F.col("factor_name").alias("factor_name_2"), F.col("_x").alias("_z"), F.col("_xx").alias("_zz"))
    grid = sums.join(F.broadcast(second)).join(F.broadcast(n)).join(products, ["factor_name", "factor_name_2"], "left")  # factors x factors
    spread = lambda s, ss: F.col("_n") * F.col(ss) - F.col(s) ** 2
    both = spread("_x", "_xx") * spread("_z", "_zz")
    r = (F.col("_n") * F.coalesce("_xy", F.lit(0.0)) - F.col("_x") * F.col("_z")) / F.sqrt(both)
    small = 1e-12 * (F.col("_n") * F.col("_xx")) * (F.col("_n") * F.col("_zz"))
    return grid.select("factor_name", "factor_name_2", F.when(both > small, r).otherwise(0.0).alias("correlation"))


def exposure_section(residuals: DataFrame, styles: list[str]) -> DataFrame:
    """Statistics, histograms and correlations of the last date's exposures, and turnover from week to week of its factors."""
    last = residuals.join(F.broadcast(residuals.agg(F.max("date").alias("date"))), "date", "left_semi")
    sparse = exposures_of(last, styles)
    factors = sparse.select("factor_name").distinct()
    # One date's securities by some 50 factors.
    filled = last.select("ric").join(F.broadcast(factors)).join(sparse.select("ric", "factor_name", "exposure"), ["ric", "factor_name"], "left").fillna(0.0, ["exposure"])
    p = F.percentile("exposure", [0.01, 0.99])
    stats = filled.groupBy("factor_name").agg(F.avg("exposure").alias("mean"), F.stddev_pop("exposure").alias("std"), p[0].alias("p1"), p[1].alias("p99"), F.max(F.abs("exposure")).alias("max_abs"))
    weeks = exposures_of(residuals.join(F.broadcast(week_ends(residuals)), "date", "left_semi"), styles).join(F.broadcast(factors), "factor_name", "left_semi")
    turnover = V.exposure_turnover(weeks, "date", "ric").withColumn("interval_days", F.col("interval_days").cast("double"))
    factor, value = F.col("factor_name"), F.col("value")
    return together([
        part(stats.unpivot("factor_name", ["mean", "std", "p1", "p99", "max_abs"], "other", "value"), 2, "factor_stats", name=factor, other=F.col("other"), value=value),
        part(histograms(filled, "factor_name", "exposure", EXPOSURE_BINS), 2, "factor_histogram", name=factor, place=F.col("place"), x=F.col("x"), value=F.col("n")),
        part(sparse_correlations(sparse), 2, "exposure_correlation", name=factor, other=F.col("factor_name_2"), value=F.col("correlation")),
        part(turnover.unpivot("date", ["turnover", "roll60", "raw_turnover", "interval_days"], "name", "value"), 2, "turnover_series", name=F.col("name"), date=F.col("date"), value=value),
    ])


def filled_returns(returns: DataFrame) -> DataFrame:
    """(date, factor_name, ret, vol): each factor's return on every date, 0 where it has none, and its rolling volatility of a year."""
    grid = returns.select("date").distinct().join(F.broadcast(returns.select("factor_name").distinct()))  # dates x factors
    rows = grid.join(returns.select("date", "factor_name", F.col("factor_return").alias("ret")), ["date", "factor_name"], "left").fillna(0.0, ["ret"])
    w = T.rows_before("factor_name", "date", VOL_DAYS)
    return rows.withColumn("vol", T.guarded(F.stddev_samp("ret").over(w) * F.sqrt(F.lit(YEAR)), F.count("ret").over(w), VOL_LEAST))


def growth(ret: Column, key: str, date: str) -> Column:
    """The running product of 1 + ret, less 1. A return below -100 % turns the sign, as it does for factors, which aren't held; one of -100 % leaves -1."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    x = 1 + ret
    sign = F.when(F.sum((x < 0).cast("int")).over(w) % 2 == 0, 1.0).otherwise(-1.0)
    product = F.when(F.max((x == 0).cast("int")).over(w) == 1, 0.0).otherwise(sign * F.exp(F.sum(F.log(F.nullif(F.abs(x), F.lit(0.0)))).over(w)))
    return product - 1


def return_section(rows: DataFrame) -> DataFrame:
    """Cumulative returns, rolling volatilities, correlations and histograms of factor returns (rows: filled_returns)."""
    total = rows.withColumn("total", growth(F.col("ret"), "factor_name", "date"))
    second = rows.select("date", F.col("factor_name").alias("factor_name_2"), F.col("ret").alias("_y"))
    c = F.corr("ret", "_y")
    pairs = rows.join(second, "date").groupBy("factor_name", "factor_name_2").agg(c.alias("c"))
    factor, date = F.col("factor_name"), F.col("date")
    return together([
        part(total, 3, "cumulative_return", name=factor, date=date, value=F.col("total")),
        part(rows, 3, "rolling_vol", name=factor, date=date, value=F.coalesce("vol", F.lit(0.0))),
        part(pairs, 3, "return_correlation", name=factor, other=F.col("factor_name_2"), value=F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0))),
        part(histograms(rows, "factor_name", "ret", RETURN_BINS), 3, "return_histogram", name=factor, place=F.col("place"), x=F.col("x"), value=F.col("n")),
    ])


def model_books(positions: DataFrame, index: DataFrame, *, key: str = "ric") -> DataFrame:
    """(account, key, weight) of four books: current, long_only and dollar_neutral with equal weights, and index, which holds that key alone.

    positions: (key, weight, market_value) of one book.
    """
    up, down = F.col("market_value") > 0, F.col("market_value") < 0
    sides = positions.agg(F.count(F.when(up, 1)).alias("_up"), F.count(F.when(down, 1)).alias("_down"))
    cell = lambda n, w: F.struct(F.lit(n).alias("account"), w.cast("double").alias("weight"))
    even = F.when(up, 1 / F.col("_up"))
    cells = F.array(cell("current", F.col("weight")), cell("long_only", even), cell("dollar_neutral", even.when(down, -1 / F.col("_down"))))
    books = positions.join(F.broadcast(sides)).select(key, F.inline(cells)).where("weight is not null")
    return books.unionByName(index.select(key, F.lit("index").alias("account"), F.lit(1.0).alias("weight")))


def realized_vol(books: DataFrame, returns: DataFrame, *, key: str = "ric", days: int = REALIZED_DAYS) -> DataFrame:
    """(account, realized): volatility of a year from the last `days` dates on which any book's key has a row; a return that is missing is 0, and so are fewer than 3 dates."""
    held = returns.join(books.select(key).distinct(), key, "left_semi")
    last = held.select("date").distinct().orderBy(F.desc("date")).limit(days)
    daily = books.join(held.join(F.broadcast(last), "date", "left_semi"), key).groupBy("account", "date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    grid = books.select("account").distinct().join(F.broadcast(last))  # books x days
    sums = grid.join(daily, ["account", "date"], "left").fillna(0.0, ["ret"]).groupBy("account").agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("s"))
    return sums.select("account", F.when(F.col("n") >= 3, F.col("s") * F.sqrt(F.lit(YEAR))).otherwise(0.0).alias("realized"))


def risk_section(covariance: DataFrame, books: DataFrame, exposures: DataFrame, specific: DataFrame, returns: DataFrame, rows: DataFrame) -> DataFrame:
    """Eigenvalues, forecast and realised volatility of books, and the mean rolling volatility of factors. specific: (ric, specific_var); returns: (ric, date, ret)."""
    cells = P.quadratic_cells(P.book_exposures(books, exposures), covariance).groupBy("account").agg(F.sum("part").alias("v"))
    own = P.specific_variance(books, specific)
    variance = F.greatest(F.coalesce("v", F.lit(0.0)) + F.coalesce("specific_var", F.lit(0.0)), F.lit(0.0))
    both = books.select("account").distinct().join(cells, "account", "left").join(own, "account", "left").join(realized_vol(books, returns), "account", "left")
    both = both.select("account", F.sqrt(variance).alias("forecast"), F.coalesce("realized", F.lit(0.0)).alias("realized"))
    values = M.eigenvalues(covariance.select(F.lit("all").alias("model"), "factor_name", "factor_name_2", "covariance"))
    means = rows.groupBy("date").agg(F.coalesce(F.avg("vol"), F.lit(0.0)).alias("vol"))
    return together([
        part(values, 4, "eigenvalues", place=F.col("place"), value=F.col("eigenvalue")),
        part(both.unpivot("account", ["forecast", "realized"], "other", "value"), 4, "forecast_and_realized", name=F.col("account"), other=F.col("other"), value=F.col("value")),
        part(means, 4, "average_factor_vol", date=F.col("date"), value=F.col("vol")),
    ])


def in_price_life(rows: DataFrame, prices: DataFrame, *, key: str = "ric", date: str = "date") -> DataFrame:
    """rows dated from the first to the last price of their key."""
    life = prices.groupBy(key).agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    return rows.join(life, key).where(F.col(date).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def field_coverage(rows: DataFrame, fields: dict[str, Column], *, key: str = "ric", date: str = "date", expected: bool = False) -> DataFrame:
    """By field how much of it is there: rows, dates and keys in percent, and a score of them.

    fields: name -> whether a row has the field. expected: only rows of keys that have the field at least once count, so what a key
    never reports isn't missing. Of dates with the lowest share the first is the worst.
    """
    cells = rows.select(key, date, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit(False)).cast("int").alias("ok")) for n, c in fields.items()])))
    ids = cells.groupBy("field", key).agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    if expected:
        ids = ids.where("ok > 0")
        cells = cells.join(ids.select("field", key), ["field", key], "left_semi")
    share, low = F.col("ok") / F.col("n") * 100, F.count(F.when(F.col("pct") < LOW, 1)).cast("double")
    by_key = ids.withColumn("pct", share).groupBy("field").agg(F.sum("n").cast("double").alias("total_rows"), F.sum("ok").cast("double").alias("non_null_rows"), F.avg("pct").alias("key_pct"), F.percentile("pct", 0.1).alias("key_pct_p10"), low.alias("keys_below"), F.count("*").cast("double").alias("keys"))
    days = cells.groupBy("field", date).agg(F.count("*").alias("n"), F.sum("ok").alias("ok")).withColumn("pct", share)
    by_day = days.groupBy("field").agg(F.avg("pct").alias("date_pct"), F.min(F.struct("pct", F.col(date).alias("d"))).alias("_worst"), low.alias("dates_below"))
    out = by_key.join(by_day, "field").withColumn("row_pct", F.col("non_null_rows") / F.col("total_rows") * 100)
    out = out.withColumns({"worst_date": F.col("_worst.d"), "worst_date_pct": F.col("_worst.pct"), "score": 0.4 * F.col("row_pct") + 0.4 * F.col("key_pct") + 0.2 * F.col("key_pct_p10")})
    return out.drop("_worst")


def coverage_section(tables: dict[str, tuple[DataFrame, dict[str, Column], bool]], prices: DataFrame, *, key: str = "ric", date: str = "date") -> DataFrame:
    """Coverage of source tables (name -> rows, fields, expected) over the price life of each key, with the worst date of a field."""
    parts = []
    for name, (rows, fields, expected) in sorted(tables.items()):
        rows = in_price_life(rows, prices, key=key, date=date)
        found = field_coverage(rows, fields, key=key, date=date, expected=expected)
        measures = [c for c in found.columns if c not in ("field", "worst_date")]
        each = found.unpivot(["field", "worst_date"], measures, "other", "value")
        counts = rows.agg(F.count("*").cast("double").alias("rows"), F.count_distinct(date).cast("double").alias("dates"), F.count_distinct(key).cast("double").alias("keys"))
        low = found.agg(F.count(F.when(F.col("score") < LOW, 1)).cast("double").alias("v"))
        parts += [
            part(each, 5, name, name=F.col("field"), other=F.col("other"), date=F.when(F.col("other") == "worst_date_pct", F.col("worst_date")), value=F.col("value")),
            part(counts.unpivot([], ["rows", "dates", "keys"], "other", "value"), 5, name, other=F.col("other"), value=F.col("value")),
            part(low, 5, name, other=F.lit("low_fields"), value=F.col("v")),
        ]
    return together(parts)
