"""Queries for window, calendar and time-series operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from ..operators import relational as R
from ..operators import timeseries as S
from ..sources import adapters as A
from .catalog import query


def r6(c):
    return sql_round(c, 6)


def short(spark, d):
    """Features with windows that 30 days can fill."""
    return S.price_features(A.prices(spark, d), lag=3, long_lag=10, vol=8, vol_least=4, adv=5, adv_least=3, short=5, short_least=3, year=15, year_least=8)


F_SQL = ", x AS (SELECT *, close / lag(close) OVER w - 1 AS ret, lag(close, 3) OVER w AS l3, lag(close, 10) OVER w AS l10 FROM prices WINDOW w AS (PARTITION BY ric ORDER BY date)) "


@query("f01_momentum", F_SQL + "SELECT ric, date, round(l3 / l10 - 1, 6) AS momentum_raw, round(-(close / l3 - 1), 6) AS st_reversal_raw FROM x")
def f01(spark, d):
    return short(spark, d).select("ric", "date", r6("momentum_raw").alias("momentum_raw"), r6("st_reversal_raw").alias("st_reversal_raw"))


@query("f02_bridging_return", F_SQL + "SELECT ric, date, round(ret, 6) AS ret FROM x")
def f02(spark, d):
    return short(spark, d).select("ric", "date", r6("ret").alias("ret"))


PANEL = ", c AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM prices)), y AS (SELECT p.ric, p.date, CASE WHEN lag(p.date) OVER w = c.before THEN p.close / lag(p.close) OVER w - 1 END AS ret FROM prices p JOIN c USING (date) WINDOW w AS (PARTITION BY ric ORDER BY p.date))"


@query("f03_panel_return", PANEL + " SELECT ric, date, round(ret, 6) AS ret FROM y")
def f03(spark, d):
    return S.panel_returns(A.prices(spark, d)).select("ric", "date", r6("ret").alias("ret"))


@query("f04_rolling_std", F_SQL + "SELECT ric, date, round(CASE WHEN count(ret) OVER w >= 4 THEN stddev_samp(ret) OVER w END, 6) AS resid_vol_raw FROM x WINDOW w AS (PARTITION BY ric ORDER BY date ROWS 7 PRECEDING)")
def f04(spark, d):
    return short(spark, d).select("ric", "date", r6("resid_vol_raw").alias("resid_vol_raw"))


@query("f05_rolling_means", "SELECT ric, date, round(CASE WHEN count(*) OVER a >= 3 THEN avg(close * volume) OVER a END, 6) AS adv, round(CASE WHEN count(*) OVER a >= 3 THEN avg(volume) OVER a END, 6) AS avg_volume_short, round(CASE WHEN count(*) OVER b >= 8 THEN avg(volume) OVER b END, 6) AS avg_volume_year FROM prices WINDOW a AS (PARTITION BY ric ORDER BY date ROWS 4 PRECEDING), b AS (PARTITION BY ric ORDER BY date ROWS 14 PRECEDING)")
def f05(spark, d):
    return short(spark, d).select("ric", "date", *[r6(c).alias(c) for c in ("adv", "avg_volume_short", "avg_volume_year")])


@query("f06_rolling_beta", F_SQL + ", m AS (SELECT date, median(ret) AS mkt FROM x WHERE close >= 5 AND ret IS NOT NULL GROUP BY 1), z AS (SELECT x.*, m.mkt FROM x LEFT JOIN m USING (date)) SELECT ric, date, round(CASE WHEN count(CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END) OVER w >= 8 THEN covar_samp(ret, mkt) OVER w END / nullif(CASE WHEN count(mkt) OVER w >= 8 THEN var_samp(mkt) OVER w END, 0), 5) AS beta FROM z WINDOW w AS (PARTITION BY ric ORDER BY date ROWS 14 PRECEDING)")
def f06(spark, d):
    rows = short(spark, d)
    market = rows.where("close >= 5 and ret is not null").groupBy("date").agg(F.median("ret").alias("mkt"))
    rows = rows.join(market, "date", "left")
    return rows.select("ric", "date", sql_round(S.rolling_beta(rows, "ret", "mkt", n=15, least=8), 5).alias("beta"))


@query("f07_change_of_filings", "SELECT ric, as_of_date, seq, round(market_cap / lag(market_cap, 4) OVER (PARTITION BY ric ORDER BY as_of_date, seq) - 1, 6) AS growth FROM fundamentals")
def f07(spark, d):
    w = Window.partitionBy("ric").orderBy("as_of_date", "seq")
    return A.fundamentals(spark, d).select("ric", "as_of_date", "seq", r6(F.try_divide(F.col("market_cap"), F.lag("market_cap", 4).over(w)) - 1).alias("growth"))


@query("f08_lagged_cap", "SELECT ric, as_of_date, seq, lag(market_cap) OVER (PARTITION BY ric ORDER BY as_of_date, seq) AS cap_lag FROM fundamentals")
def f08(spark, d):
    return A.fundamentals(spark, d).select("ric", "as_of_date", "seq", F.lag("market_cap").over(Window.partitionBy("ric").orderBy("as_of_date", "seq")).alias("cap_lag"))


@query("f09_rolling_fallback", F_SQL + ", r AS (SELECT date, avg(abs(ret)) AS r2 FROM x GROUP BY 1) SELECT date, round(coalesce(CASE WHEN count(r2) OVER a >= 4 THEN avg(r2) OVER a END, r2), 6) AS r2_short, round(coalesce(CASE WHEN count(r2) OVER b >= 8 THEN avg(r2) OVER b END, r2), 6) AS r2_long FROM r WINDOW a AS (ORDER BY date ROWS 11 PRECEDING), b AS (ORDER BY date ROWS 51 PRECEDING)")
def f09(spark, d):
    """One row a date, so one window over all of them."""
    rows = short(spark, d).groupBy("date").agg(F.avg(F.abs("ret")).alias("r2"))
    mean = lambda n, least: S.guarded(F.avg("r2").over(Window.orderBy("date").rowsBetween(-(n - 1), 0)), F.count("r2").over(Window.orderBy("date").rowsBetween(-(n - 1), 0)), least)
    return rows.select("date", r6(F.coalesce(mean(12, 4), "r2")).alias("r2_short"), r6(F.coalesce(mean(52, 8), "r2")).alias("r2_long"))


@query("f10_annual_vol", F_SQL + ", v AS (SELECT ric, date, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END * sqrt(252) AS vol FROM x WINDOW w AS (PARTITION BY ric ORDER BY date ROWS 9 PRECEDING)) SELECT date, round(avg(vol), 6) AS vol FROM v GROUP BY 1")
def f10(spark, d):
    rows = short(spark, d)
    w = S.rows_before("ric", "date", 10)
    rows = rows.withColumn("vol", S.guarded(F.stddev_samp("ret").over(w), F.count("ret").over(w), 5) * F.sqrt(F.lit(252.0)))
    return rows.groupBy("date").agg(r6(F.avg("vol")).alias("vol"))


@query("f11_compounded_return", F_SQL + ", r AS (SELECT ric, date, least(ret, 0.9) / 10 AS r FROM x WHERE ret IS NOT NULL) SELECT ric, date, round(exp(sum(ln(1 + r)) OVER (PARTITION BY ric ORDER BY date)) - 1, 6) AS total FROM r")
def f11(spark, d):
    rows = short(spark, d).where("ret is not null").withColumn("r", F.least("ret", F.lit(0.9)) / 10)
    return rows.select("ric", "date", r6(S.compounded(F.col("r"), "ric", "date")).alias("total"))


@query("f12_cumulative_sum", F_SQL + "SELECT ric, date, round(sum(ret) OVER (PARTITION BY ric ORDER BY date), 6) AS total FROM x WHERE ret IS NOT NULL")
def f12(spark, d):
    w = Window.partitionBy("ric").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return short(spark, d).where("ret is not null").select("ric", "date", r6(F.sum("ret").over(w)).alias("total"))


def week_sql(forward):
    friday = "(date_trunc('week', date)::DATE + 4)"
    week = f"CASE WHEN dayofweek(date) IN (0, 6) THEN {friday} + 7 ELSE {friday} END" if forward else friday
    return f", w AS (SELECT ric, date, close, {week} AS week FROM long_prices) SELECT ric, week, max(date) AS date, round(arg_max(close, date), 6) AS close FROM w GROUP BY 1, 2"


@query("f13_week_back", week_sql(False))
def f13(spark, d):
    return S.weekly_close(A.long_prices(spark, d), False).select("ric", "week", "date", r6("close").alias("close"))


@query("f13b_week_forward", week_sql(True))
def f13b(spark, d):
    return S.weekly_close(A.long_prices(spark, d), True).select("ric", "week", "date", r6("close").alias("close"))


@query("f14_week_samples", "SELECT date_trunc('week', date)::DATE + 4 AS week, max(date) AS date FROM long_prices GROUP BY 1")
def f14(spark, d):
    return A.long_prices(spark, d).groupBy(S.week_friday(F.col("date"), False).alias("week")).agg(F.max("date").alias("date"))


ANCHORS = ", s AS (SELECT DISTINCT date FROM long_prices), a AS (SELECT g.day::DATE AS friday, (SELECT max(date) FROM s WHERE date <= g.day) AS anchor FROM (SELECT unnest(generate_series(DATE '1998-01-02', DATE '1999-01-01', INTERVAL 7 DAY)) AS day) g)"


def anchors(spark, d):
    """Fridays, or the session before; 53 of them."""
    fridays = spark.sql("SELECT explode(sequence(date'1998-01-02', date'1999-01-01', interval 7 days)) AS friday")
    sessions = A.long_prices(spark, d).select("date").distinct().withColumn("k", F.lit(1))
    return R.asof_backward(fridays.withColumn("k", F.lit(1)), sessions.withColumn("session", F.col("date")), "k", "friday", "date", [], ["session"]).select("friday", F.col("session").alias("anchor"))


@query("f15_weekly_anchors", ANCHORS + ", n AS (SELECT *, row_number() OVER (ORDER BY friday DESC) - 1 AS age FROM a) SELECT friday, anchor, round(exp(-ln(2) * age / 26) / sum(exp(-ln(2) * age / 26)) OVER (), 6) AS weight FROM n")
def f15(spark, d):
    a = anchors(spark, d).withColumn("k", F.lit(1))
    return a.select("friday", "anchor", r6(S.decay_weights(a, ["k"], "friday", 26.0)).alias("weight"))


@query("f16_anchor_prices", ANCHORS + ", p AS (SELECT x.ric, a.anchor, x.date, x.close FROM long_prices x JOIN a ON x.date BETWEEN date_trunc('week', a.anchor)::DATE AND a.anchor), l AS (SELECT ric, anchor, max(date) AS date, arg_max(close, date) AS close FROM p GROUP BY 1, 2) SELECT i.ric, a.anchor, l.date, round(l.close, 6) AS close FROM (SELECT DISTINCT ric FROM long_prices) i CROSS JOIN (SELECT DISTINCT anchor FROM a) a LEFT JOIN l ON l.ric = i.ric AND l.anchor = a.anchor")
def f16(spark, d):
    return S.anchored_weeks(A.long_prices(spark, d), anchors(spark, d).select("anchor").distinct()).select("ric", "anchor", "date", r6("close").alias("close"))


@query("f17_longest_gap", ANCHORS + ", g AS (SELECT i.ric, a.anchor, exists(SELECT 1 FROM long_prices x WHERE x.ric = i.ric AND x.date BETWEEN date_trunc('week', a.anchor)::DATE AND a.anchor) AS ok FROM (SELECT DISTINCT ric FROM long_prices) i CROSS JOIN (SELECT DISTINCT anchor FROM a) a), h AS (SELECT *, sum(ok::INT) OVER (PARTITION BY ric ORDER BY anchor) AS island FROM g), k AS (SELECT ric, island, sum((NOT ok)::INT) AS run FROM h GROUP BY 1, 2) SELECT ric, cast(max(run) AS BIGINT) AS longest_gap FROM k GROUP BY 1")
def f17(spark, d):
    weeks = S.anchored_weeks(A.long_prices(spark, d), anchors(spark, d).select("anchor").distinct()).withColumn("ok", F.col("close").isNotNull())
    return R.longest_gap(weeks, ["ric"], "anchor", "ok")


@query("f18_field_usage", ", u AS (SELECT ric, CASE WHEN volume > 30 THEN 'adj_close' ELSE 'close' END AS field FROM long_prices WHERE date < DATE '1995-06-01') SELECT i.ric, CASE count(DISTINCT u.field) WHEN 0 THEN 'none' WHEN 1 THEN min(u.field) ELSE 'mixed' END AS used FROM (SELECT DISTINCT ric FROM long_prices) i LEFT JOIN u USING (ric) GROUP BY 1")
def f18(spark, d):
    p = A.long_prices(spark, d)
    field = F.when(F.col("date") < F.lit("1995-06-01").cast("date"), F.when(F.col("volume") > 30, "adj_close").otherwise("close"))
    used = p.groupBy("ric").agg(F.collect_set(field).alias("s"))
    return used.select("ric", F.when(F.size("s") == 0, "none").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("mixed").alias("used"))


@query("f19_decay_weights", ", n AS (SELECT ric, date, row_number() OVER (PARTITION BY ric ORDER BY date DESC) - 1 AS age FROM prices) SELECT ric, date, round(power(0.5, age / 84.0) / sum(power(0.5, age / 84.0)) OVER (PARTITION BY ric), 6) AS weight FROM n")
def f19(spark, d):
    p = A.prices(spark, d)
    return p.select("ric", "date", r6(S.decay_weights(p, ["ric"], "date", 84.0)).alias("weight"))


@query("f20_drop_alert", ", c AS (SELECT date, count(*) AS n FROM prices WHERE volume >= 2 GROUP BY 1), l AS (SELECT date, n, lag(n) OVER (ORDER BY date) AS p FROM c) SELECT date, n, round((p - n) / p, 6) AS fall, CASE WHEN (p - n) / p > 0.2 THEN 'critical' WHEN (p - n) / p > 0.1 THEN 'warn' ELSE '' END AS alert FROM l")
def f20(spark, d):
    """One row a date."""
    c = A.prices(spark, d).where("volume >= 2").groupBy("date").agg(F.count("*").alias("n")).withColumn("p", F.lag("n").over(Window.orderBy("date")))
    fall = F.try_divide(F.col("p") - F.col("n"), F.col("p"))
    return c.select("date", "n", r6(fall).alias("fall"), F.when(fall > 0.2, "critical").when(fall > 0.1, "warn").otherwise("").alias("alert"))


@query("f21_lagged_session", ", s AS (SELECT DISTINCT date FROM long_prices) SELECT date, (SELECT max(date) FROM s t WHERE t.date <= s.date - 7) AS exposure_date FROM s")
def f21(spark, d):
    s = A.long_prices(spark, d).select("date").distinct()
    shifted = s.select("date", F.date_sub("date", 7).alias("day"), F.lit(1).alias("k"))
    return R.asof_backward(shifted, s.select(F.col("date").alias("session"), F.col("date").alias("exposure_date"), F.lit(1).alias("k")), "k", "day", "session", [], ["exposure_date"]).select("date", "exposure_date")


@query("f22_target_dates", "SELECT DISTINCT date FROM long_prices WHERE dayofweek(date) = 5 UNION SELECT max(date) FROM long_prices")
def f22(spark, d):
    s = A.long_prices(spark, d).select("date").distinct()
    return s.where(F.dayofweek("date") == 6).union(s.agg(F.max("date"))).distinct()


@query("f23_period_anchors", ", s AS (SELECT DISTINCT date FROM long_prices), m AS (SELECT DISTINCT last_day(date) AS month_end FROM s) SELECT month_end, (SELECT max(date) FROM s WHERE date <= month_end) AS anchor, month(month_end) % 3 = 0 AS quarter FROM m")
def f23(spark, d):
    s = A.long_prices(spark, d).select("date").distinct()
    return s.groupBy(F.last_day("date").alias("month_end")).agg(F.max("date").alias("anchor")).select("month_end", "anchor", (F.month("month_end") % 3 == 0).alias("quarter"))


@query("f24_date_chunks", "SELECT cast(k AS BIGINT) AS chunk, min(date) AS first, max(date) AS last, count(*) AS sessions FROM (SELECT date, floor(date_diff('day', (SELECT min(date) FROM long_prices), date) / 90) AS k FROM (SELECT DISTINCT date FROM long_prices)) GROUP BY 1")
def f24(spark, d):
    s = A.long_prices(spark, d).select("date").distinct()
    first = s.agg(F.min("date").alias("start"))
    return s.join(F.broadcast(first)).groupBy(F.floor(F.datediff("date", "start") / 90).alias("chunk")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("sessions"))


@query("f26_zero_filled_returns", PANEL + " SELECT ric, date, round(coalesce(ret, 0), 6) AS ret FROM y")
def f26(spark, d):
    return S.panel_returns(A.prices(spark, d)).select("ric", "date", r6(F.coalesce("ret", F.lit(0.0))).alias("ret"))


@query("s01_string_functions", "SELECT p_partkey, upper(trim(p_name)) AS name, nullif(split_part(p_name, ' ', 2), '') AS second, p_name LIKE '%ring%' AS is_ring, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS slug, strpos(p_name, 'i') AS at FROM part")
def s01(spark, d):
    p = A.read(spark, d, "part")
    return p.select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.nullif(F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")), F.lit("")).alias("second"), F.col("p_name").like("%ring%").alias("is_ring"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_").alias("slug"), F.instr("p_name", "i").cast("long").alias("at"))


@query("s02_date_functions", "SELECT o_orderkey, cast(o_orderdate AS DATE) AS day, cast(o_orderdate AS DATE) + 30 AS later, date_trunc('month', o_orderdate)::DATE AS month, date_trunc('quarter', o_orderdate)::DATE AS quarter, last_day(o_orderdate) AS month_end, (dayofweek(o_orderdate) + 6) % 7 AS weekday FROM orders")
def s02(spark, d):
    o = A.read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.select("o_orderkey", "day", F.date_add("day", 30).alias("later"), F.trunc("day", "month").alias("month"), F.trunc("day", "quarter").alias("quarter"), F.last_day("day").alias("month_end"), F.weekday("day").cast("long").alias("weekday"))


@query("s03_math_functions", "SELECT c_custkey, round(ln(greatest(c_acctbal, 1)), 6) AS size, round(sqrt(abs(c_acctbal)), 6) AS root, round(power(c_acctbal / 1000, 3), 6) AS cube, least(greatest(c_acctbal, 0), 5000) AS clipped, round(exp(c_acctbal / 10000), 6) AS e FROM customer")
def s03(spark, d):
    b = F.col("c_acctbal")
    return A.read(spark, d, "customer").select("c_custkey", r6(F.log(F.greatest(b, F.lit(1.0)))).alias("size"), r6(F.sqrt(F.abs(b))).alias("root"), r6(F.pow(b / 1000, F.lit(3.0))).alias("cube"), F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)).alias("clipped"), r6(F.exp(b / 10000)).alias("e"))


@query("s04_json_maps", "SELECT event_type, cast(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def s04(spark, d):
    parsed = F.from_json("props", "k long")
    return A.read(spark, d, "events").groupBy("event_type", parsed["k"].alias("k")).agg(F.count("*").alias("n"))


@query("s05_conditionals", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_totalprice > 300000 THEN 'large' ELSE coalesce(nullif(o_orderpriority, '5-LOW'), 'none') END AS label FROM orders")
def s05(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_totalprice") > 300000, "large").otherwise(F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")))
    return A.read(spark, d, "orders").select("o_orderkey", label.alias("label"))
