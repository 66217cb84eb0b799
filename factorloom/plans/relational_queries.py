"""Queries for joins, latest rows and aggregates, over the adapters' tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from ..operators import relational as R
from ..operators import search as T
from ..sources import adapters as A
from .catalog import query


def r6(c):
    return sql_round(c, 6)


@query("a04_window_scan", "SELECT p.ric, p.date, round(close, 6) AS close, volume FROM prices p WHERE p.date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' AND p.ric IN (SELECT cast(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')")
def a04(spark, d):
    ids = A.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("ric"))
    return A.prices(spark, d).where("date between date'2024-01-10' and date'2024-01-15'").join(ids, "ric", "left_semi").select("ric", "date", r6("close").alias("close"), "volume")


@query("c01_asof_backward", ", one AS (SELECT ric, as_of_date, max(seq) AS seq, arg_max(market_cap, seq) AS market_cap FROM fundamentals GROUP BY 1, 2) SELECT p.ric, p.date, f.as_of_date, f.market_cap FROM long_prices p ASOF LEFT JOIN one f ON p.ric = f.ric AND p.date >= f.as_of_date")
def c01(spark, d):
    return R.asof_backward(A.long_prices(spark, d).select("ric", "date"), A.fundamentals(spark, d), "ric", "date", "as_of_date", ["seq"], ["market_cap"]).select("ric", "date", "as_of_date", "market_cap")


@query("c02_asof_scalar", "SELECT d.day, (SELECT max(date) FROM prices WHERE date <= d.day) AS session FROM (SELECT cast(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day) d")
def c02(spark, d):
    sessions = A.prices(spark, d).select("date").distinct()
    days = spark.sql("SELECT explode(sequence(date'2023-12-30', date'2024-02-03')) AS day")
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # A calendar is a few thousand days; one partition holds it.
    return days.join(sessions, F.col("day") == F.col("date"), "left").withColumn("session", F.max("date").over(w)).select("day", "session")


@query("c03_asof_fill", ", e AS (SELECT ric, as_of_date, seq, CASE WHEN status <> 'P' THEN market_cap END AS cap, CASE WHEN status <> 'F' THEN priority END AS priority FROM fundamentals) SELECT p.ric, p.date, (SELECT cap FROM e WHERE e.ric = p.ric AND as_of_date <= p.date AND cap IS NOT NULL ORDER BY as_of_date DESC, seq DESC LIMIT 1) AS cap, (SELECT priority FROM e WHERE e.ric = p.ric AND as_of_date <= p.date AND priority IS NOT NULL ORDER BY as_of_date DESC, seq DESC LIMIT 1) AS priority FROM (SELECT ric, date FROM long_prices WHERE date >= DATE '2000-01-01') p")
def c03(spark, d):
    events = A.fundamentals(spark, d).select("ric", "as_of_date", "seq", F.when(F.col("status") != "P", F.col("market_cap")).alias("cap"), F.when(F.col("status") != "F", F.col("priority")).alias("priority"))
    return R.asof_fill(A.long_prices(spark, d).where("date >= date'2000-01-01'").select("ric", "date"), events, "ric", "date", "as_of_date", ["seq"], ["cap", "priority"])


@query("c03_asof_fill_all", ", e AS (SELECT ric, as_of_date, seq, CASE WHEN status <> 'P' THEN market_cap END AS cap, CASE WHEN status <> 'F' THEN priority END AS priority FROM fundamentals), x AS (SELECT ric, as_of_date, arg_max(cap, seq) AS cap FROM e WHERE cap IS NOT NULL GROUP BY 1, 2), y AS (SELECT ric, as_of_date, arg_max(priority, seq) AS priority FROM e WHERE priority IS NOT NULL GROUP BY 1, 2) SELECT p.ric, p.date, x.cap, y.priority FROM long_prices p ASOF LEFT JOIN x ON p.ric = x.ric AND p.date >= x.as_of_date ASOF LEFT JOIN y ON p.ric = y.ric AND p.date >= y.as_of_date")
def c03_all(spark, d):
    """c03 over all dates."""
    events = A.fundamentals(spark, d).select("ric", "as_of_date", "seq", F.when(F.col("status") != "P", F.col("market_cap")).alias("cap"), F.when(F.col("status") != "F", F.col("priority")).alias("priority"))
    return R.asof_fill(A.long_prices(spark, d).select("ric", "date"), events, "ric", "date", "as_of_date", ["seq"], ["cap", "priority"])


@query("c04_identity_scope", "SELECT p.ric, p.date, r.ticker FROM prices p JOIN registry r USING (ric)")
def c04(spark, d):
    return A.prices(spark, d).join(A.registry(spark, d), "ric").select("ric", "date", "ticker")


@query("c05_left_chain", ", f AS (SELECT ric, max(as_of_date) AS as_of_date, count(*) AS filings FROM fundamentals GROUP BY 1), q AS (SELECT ric, max(date) AS last_price FROM prices GROUP BY 1) SELECT r.ric, r.sector, q.last_price, f.as_of_date, coalesce(f.filings, 0) AS filings FROM registry r LEFT JOIN q USING (ric) LEFT JOIN f USING (ric)")
def c05(spark, d):
    f = A.fundamentals(spark, d).groupBy("ric").agg(F.max("as_of_date").alias("as_of_date"), F.count("*").alias("filings"))
    q = A.prices(spark, d).groupBy("ric").agg(F.max("date").alias("last_price"))
    return A.registry(spark, d).join(q, "ric", "left").join(f, "ric", "left").select("ric", "sector", "last_price", "as_of_date", F.coalesce("filings", F.lit(0)).alias("filings"))


@query("c06_registry_quotes", ", f AS (SELECT * FROM fundamentals QUALIFY row_number() OVER (PARTITION BY ric ORDER BY as_of_date DESC, seq DESC) = 1), q AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ric ORDER BY date DESC) = 1) SELECT r.ric, r.ticker, r.country, f.market_cap, f.as_of_date, round(q.close, 6) AS close, q.date FROM registry r LEFT JOIN f USING (ric) LEFT JOIN q USING (ric)")
def c06(spark, d):
    f = R.latest(A.fundamentals(spark, d), ["ric"], [F.desc("as_of_date"), F.desc("seq")])
    q = R.latest(A.prices(spark, d), ["ric"], [F.desc("date")])
    return A.registry(spark, d).join(f, "ric", "left").join(q, "ric", "left").select("ric", "ticker", "country", "market_cap", "as_of_date", r6("close").alias("close"), "date")


@query("c07_orphans", "SELECT DISTINCT f.ric FROM fundamentals f WHERE f.ric NOT IN (SELECT ric FROM prices)")
def c07(spark, d):
    return A.fundamentals(spark, d).select("ric").distinct().join(A.prices(spark, d).select("ric"), "ric", "left_anti")


@query("c08_complete_packages", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def c08(spark, d):
    li = A.read(spark, d, "lineitem")
    rows = A.read(spark, d, "orders")
    for flag in ("R", "A"):
        rows = rows.join(li.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return rows.join(A.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("c09_last_dates", "SELECT ric, date, volume FROM prices WHERE date IN (SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 5)")
def c09(spark, d):
    p = A.prices(spark, d)
    return p.join(p.select("date").distinct().orderBy(F.desc("date")).limit(5), "date", "left_semi").select("ric", "date", "volume")


@query("c10_lifecycle_range", ", b AS (SELECT ric, min(date) AS first, max(date) AS last FROM long_prices WHERE volume >= 40 GROUP BY 1) SELECT p.ric, p.date FROM long_prices p JOIN b ON p.ric = b.ric AND p.date BETWEEN b.first AND b.last")
def c10(spark, d):
    p = A.long_prices(spark, d)
    bounds = p.where("volume >= 40").groupBy("ric").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return p.join(bounds, "ric").where("date between first and last").select("ric", "date")


@query("c11_group_max_join", "SELECT f.ric, f.as_of_date, f.seq FROM fundamentals f JOIN (SELECT ric, max(as_of_date) AS m FROM fundamentals GROUP BY 1) g ON f.ric = g.ric AND f.as_of_date = g.m")
def c11(spark, d):
    f = A.fundamentals(spark, d)
    return f.join(f.groupBy("ric").agg(F.max("as_of_date").alias("as_of_date")), ["ric", "as_of_date"]).select("ric", "as_of_date", "seq")


@query("c12_common_dates", "SELECT date FROM prices WHERE ric = '1' INTERSECT SELECT date FROM prices WHERE ric = '2'")
def c12(spark, d):
    p = A.prices(spark, d)
    return p.where("ric = '1'").select("date").intersect(p.where("ric = '2'").select("date"))


@query("c13_holdings_diff", ", b AS (SELECT account, sector, sum(quantity) AS q FROM holdings JOIN parts USING (ric) GROUP BY 1, 2), a AS (SELECT account, sector, sum(quantity) AS q FROM holdings JOIN parts USING (ric) WHERE quantity > 0 GROUP BY 1, 2) SELECT coalesce(a.account, b.account) AS account, coalesce(a.sector, b.sector) AS sector, cast(coalesce(b.q, 0) AS BIGINT) AS before, cast(coalesce(a.q, 0) AS BIGINT) AS after, cast(coalesce(a.q, 0) - coalesce(b.q, 0) AS BIGINT) AS delta FROM b FULL JOIN a ON a.account = b.account AND a.sector = b.sector")
def c13(spark, d):
    h = A.holdings(spark, d).join(A.parts(spark, d), "ric")
    return R.keyed_diff(h, h.where("quantity > 0"), ["account", "sector"], "quantity")


@query("c14_value_mismatch", ", l AS (SELECT ric, date, close AS x FROM prices WHERE volume <> 3), r AS (SELECT ric, date, CASE WHEN volume = 2 THEN close + 0.5 ELSE close END AS x FROM prices WHERE volume <> 4) SELECT coalesce(l.ric, r.ric) AS ric, coalesce(l.date, r.date) AS date, round(l.x, 6) AS left_value, round(r.x, 6) AS right_value FROM l FULL JOIN r ON l.ric = r.ric AND l.date = r.date WHERE l.x IS NULL OR r.x IS NULL OR abs(l.x - r.x) > 1e-9")
def c14(spark, d):
    p = A.prices(spark, d)
    right = p.where("volume <> 4").select("ric", "date", F.when(F.col("volume") == 2, F.col("close") + 0.5).otherwise(F.col("close")).alias("close"))
    return R.value_mismatches(p.where("volume <> 3"), right, ["ric", "date"], "close").select("ric", "date", r6("left_value").alias("left_value"), r6("right_value").alias("right_value"))


@query("c15_grid_gaps", "SELECT a.r_name AS factor_id, b.r_name AS factor_id_2 FROM region a CROSS JOIN region b WHERE NOT EXISTS (SELECT 1 FROM nation x JOIN nation y ON x.n_nationkey + 7 = y.n_nationkey WHERE x.n_regionkey = a.r_regionkey AND y.n_regionkey = b.r_regionkey)")
def c15(spark, d):
    """Pairs of a fixed factor list (here 5 regions, 17 in production) that a covariance table lacks."""
    r, n = A.read(spark, d, "region"), A.read(spark, d, "nation")
    grid = r.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("factor_id")).crossJoin(r.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("factor_id_2")))
    have = n.select((F.col("n_nationkey") + 7).alias("k"), F.col("n_regionkey").alias("i")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("j")), "k")
    return grid.join(have, ["i", "j"], "left_anti").select("factor_id", "factor_id_2")


@query("c17_alias_resolution", ", u AS (SELECT name, min(ric) AS ric, count(*) AS n FROM parts GROUP BY 1) SELECT h.account, h.ric, coalesce(e.ric, CASE WHEN u.n = 1 THEN u.ric END) AS fit_ric FROM (SELECT account, ric, 'x' || ric AS code FROM holdings WHERE quantity > 60) h LEFT JOIN (SELECT ric FROM parts WHERE price < 1000) e ON e.ric = h.ric LEFT JOIN parts p ON p.ric = h.ric LEFT JOIN u ON u.name = p.name")
def c17(spark, d):
    parts = A.parts(spark, d)
    unique = parts.groupBy("name").agg(F.min("ric").alias("u_ric"), F.count("*").alias("n"))
    h = A.holdings(spark, d).where("quantity > 60")
    exact = parts.where("price < 1000").select("ric", F.col("ric").alias("e_ric"))
    rows = h.join(exact, "ric", "left").join(parts.select("ric", "name"), "ric", "left").join(unique, "name", "left")
    return rows.select("account", "ric", F.coalesce("e_ric", F.when(F.col("n") == 1, F.col("u_ric"))).alias("fit_ric"))


@query("c18_ranked_resolution", ", r AS (SELECT name, ric, row_number() OVER (PARTITION BY name ORDER BY (sector <> 'Brand#1'), price DESC, ric) AS k, count(*) OVER (PARTITION BY name) AS n FROM parts) SELECT name, ric, n - 1 AS alternatives FROM r WHERE k = 1")
def c18(spark, d):
    w = Window.partitionBy("name")
    rank = F.row_number().over(w.orderBy(F.col("sector") != "Brand#1", F.desc("price"), "ric"))
    return A.parts(spark, d).select("name", "ric", rank.alias("k"), (F.count("*").over(w) - 1).alias("alternatives")).where("k = 1").select("name", "ric", "alternatives")


@query("c19_precedence_coalesce", ", o AS (SELECT * FROM fundamentals QUALIFY row_number() OVER (PARTITION BY ric ORDER BY as_of_date DESC, seq DESC) = 1), q AS (SELECT ric, max(date) AS date FROM prices GROUP BY 1) SELECT coalesce(r.ric, o.ric, q.ric) AS ric, coalesce(r.country, o.status, 'unknown') AS country, CASE WHEN r.ric IS NOT NULL THEN 'registry' WHEN o.ric IS NOT NULL THEN 'observation' ELSE 'prices' END AS origin FROM (SELECT * FROM registry WHERE sector <> 'MACHINERY') r FULL JOIN o ON r.ric = o.ric FULL JOIN q ON coalesce(r.ric, o.ric) = q.ric")
def c19(spark, d):
    r = A.registry(spark, d).where("sector <> 'MACHINERY'").select("ric", "country", F.lit(1).alias("a"))
    o = R.latest(A.fundamentals(spark, d), ["ric"], [F.desc("as_of_date"), F.desc("seq")]).select("ric", "status", F.lit(1).alias("b"))
    q = A.prices(spark, d).select("ric").distinct()
    rows = r.join(o, "ric", "full_outer").join(q, "ric", "full_outer")
    origin = F.when(F.col("a") == 1, "registry").when(F.col("b") == 1, "observation").otherwise("prices")
    return rows.select("ric", F.coalesce("country", "status", F.lit("unknown")).alias("country"), origin.alias("origin"))


@query("c20_runtime_by_date", ", days AS (SELECT DISTINCT date_trunc('quarter', as_of_date)::DATE AS day FROM fundamentals), one AS (SELECT ric, as_of_date, arg_max(status, seq) AS status FROM fundamentals GROUP BY 1, 2) SELECT x.ric, x.day, one.status FROM (SELECT r.ric, days.day FROM registry r CROSS JOIN days WHERE r.sector = 'BUILDING') x ASOF JOIN one ON x.ric = one.ric AND x.day >= one.as_of_date")
def c20(spark, d):
    """One plan for all dates: securities by date, then one as-of join. The dates are quarters, a small list."""
    f = A.fundamentals(spark, d)
    days = f.select(F.trunc("as_of_date", "quarter").alias("day")).distinct()
    grid = A.registry(spark, d).where("sector = 'BUILDING'").select("ric").join(F.broadcast(days))
    return R.asof_backward(grid, f, "ric", "day", "as_of_date", ["seq"], ["status"]).where("as_of_date is not null").select("ric", "day", "status")


@query("c20_runtime_by_date_all", ", days AS (SELECT DISTINCT date_trunc('quarter', as_of_date)::DATE AS day FROM fundamentals), one AS (SELECT ric, as_of_date, arg_max(status, seq) AS status FROM fundamentals GROUP BY 1, 2) SELECT x.ric, x.day, one.status FROM (SELECT r.ric, days.day FROM registry r CROSS JOIN days) x ASOF JOIN one ON x.ric = one.ric AND x.day >= one.as_of_date")
def c20_all(spark, d):
    """c20 over all securities."""
    f = A.fundamentals(spark, d)
    days = f.select(F.trunc("as_of_date", "quarter").alias("day")).distinct()
    grid = A.registry(spark, d).select("ric").join(F.broadcast(days))
    return R.asof_backward(grid, f, "ric", "day", "as_of_date", ["seq"], ["status"]).where("as_of_date is not null").select("ric", "day", "status")


@query("d01_latest_row", "SELECT ric, as_of_date, seq, market_cap FROM fundamentals QUALIFY row_number() OVER (PARTITION BY ric ORDER BY as_of_date DESC, seq DESC) = 1")
def d01(spark, d):
    return R.latest_wide(A.fundamentals(spark, d), ["ric"], ["as_of_date", "seq"], ["market_cap"])


@query("d02_source_priority", "SELECT ric, as_of_date, seq FROM fundamentals QUALIFY row_number() OVER (PARTITION BY ric, as_of_date ORDER BY (status <> 'F'), seq DESC) = 1")
def d02(spark, d):
    return R.latest(A.fundamentals(spark, d), ["ric", "as_of_date"], [(F.col("status") != "F").asc(), F.desc("seq")]).select("ric", "as_of_date", "seq")


@query("d03_keep_last", "SELECT ric, status, max(seq) AS seq FROM fundamentals GROUP BY 1, 2")
def d03(spark, d):
    return R.latest_wide(A.fundamentals(spark, d), ["ric", "status"], ["seq"], [])


@query("d05_group_tail", "SELECT ric, round(avg(close * volume), 6) AS adv, count(*) AS n FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ric ORDER BY date DESC) <= 20) GROUP BY 1")
def d05(spark, d):
    tail = R.latest(A.prices(spark, d), ["ric"], [F.desc("date")], 20)
    return tail.groupBy("ric").agg(r6(F.avg(F.col("close") * F.col("volume"))).alias("adv"), F.count("*").alias("n"))


@query("d06_best_listing", "SELECT name, ric FROM parts QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN ric LIKE '%0' THEN 0 WHEN ric LIKE '%1' THEN 1 WHEN ric LIKE '%2' THEN 2 ELSE 99 END, ric) = 1")
def d06(spark, d):
    rank = F.when(F.col("ric").endswith("0"), 0).when(F.col("ric").endswith("1"), 1).when(F.col("ric").endswith("2"), 2).otherwise(99)
    return R.latest(A.parts(spark, d), ["name"], [rank.asc(), F.asc("ric")]).select("name", "ric")


@query("d07_prior_fit", "SELECT ric, as_of_date, seq FROM fundamentals WHERE status = 'F' AND as_of_date < DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY ric ORDER BY as_of_date DESC, seq DESC) = 1")
def d07(spark, d):
    return R.latest(A.fundamentals(spark, d).where("status = 'F' and as_of_date < date'1998-01-01'"), ["ric"], [F.desc("as_of_date"), F.desc("seq")]).select("ric", "as_of_date", "seq")


@query("d08_remap_rebuild", ", m AS (SELECT CASE WHEN ric LIKE '%7' THEN substr(ric, 1, length(ric) - 1) || '0' ELSE ric END AS ric, as_of_date, seq FROM fundamentals) SELECT ric, as_of_date, max(seq) AS seq FROM m GROUP BY 1, 2")
def d08(spark, d):
    """Ids move to their alias, then the last row of each key stays."""
    f = A.fundamentals(spark, d)
    alias = f.where("ric like '%7'").select("ric", F.concat(F.expr("substr(ric, 1, length(ric) - 1)"), F.lit("0")).alias("to")).distinct()
    moved = f.join(alias, "ric", "left").select(F.coalesce("to", "ric").alias("ric"), "as_of_date", "seq")
    return R.latest_wide(moved, ["ric", "as_of_date"], ["seq"], [])


@query("d10_most_observed", ", c AS (SELECT ric, count(*) AS obs FROM prices GROUP BY 1) SELECT r.country, c.ric, c.obs FROM c JOIN registry r USING (ric) QUALIFY row_number() OVER (PARTITION BY r.country ORDER BY c.obs DESC, c.ric DESC) = 1")
def d10(spark, d):
    c = A.prices(spark, d).groupBy("ric").agg(F.count("*").alias("obs")).join(A.registry(spark, d).select("ric", "country"), "ric")
    return R.latest(c, ["country"], [F.desc("obs"), F.desc("ric")]).select("country", "ric", "obs")


@query("d11_ambiguous_names", "SELECT name, count(*) AS n FROM parts GROUP BY 1 HAVING count(*) > 1")
def d11(spark, d):
    return R.duplicate_keys(A.parts(spark, d), ["name"])


@query("d12_unique_alias", "SELECT name, sector, min(ric) AS ric FROM parts GROUP BY 1, 2 HAVING count(DISTINCT ric) = 1")
def d12(spark, d):
    return A.parts(spark, d).groupBy("name", "sector").agg(F.min("ric").alias("ric"), F.count_distinct("ric").alias("n")).where("n = 1").drop("n")


@query("e01_account_summary", ", a AS (SELECT cast(s_suppkey AS VARCHAR) AS account, s_name FROM supplier) SELECT a.account, a.s_name, count(h.ric) AS positions, cast(coalesce(sum(abs(h.quantity)), 0) AS BIGINT) AS gross FROM a LEFT JOIN holdings h USING (account) GROUP BY 1, 2")
def e01(spark, d):
    a = A.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("account"), "s_name")
    return a.join(A.holdings(spark, d), "account", "left").groupBy("account", "s_name").agg(F.count("ric").alias("positions"), F.coalesce(F.sum(F.abs("quantity")), F.lit(0)).alias("gross"))


@query("e02_aggregate_positions", "SELECT ric, cast(sum(quantity) AS BIGINT) AS quantity, min(account) AS first_account FROM holdings GROUP BY 1 HAVING abs(sum(quantity)) > 1e-12")
def e02(spark, d):
    return A.holdings(spark, d).groupBy("ric").agg(F.sum("quantity").alias("quantity"), F.min_by("account", "account").alias("first_account")).where("abs(quantity) > 1e-12")


@query("e08_reason_counts", ", e AS (SELECT CASE WHEN balance < 0 THEN 'missing_market_cap' END AS a, CASE WHEN sector = 'BUILDING' THEN 'non_equity' END AS b, CASE WHEN country LIKE '%1' THEN 'missing_country' END AS c FROM registry) SELECT reason, count(*) AS n FROM (SELECT a AS reason FROM e UNION ALL SELECT b FROM e UNION ALL SELECT c FROM e) WHERE reason IS NOT NULL GROUP BY 1")
def e08(spark, d):
    reason = F.concat_ws("|", F.when(F.col("balance") < 0, "missing_market_cap"), F.when(F.col("sector") == "BUILDING", "non_equity"), F.when(F.col("country").endswith("1"), "missing_country"))
    rows = A.registry(spark, d).select(F.explode(F.split(reason, r"\|")).alias("reason")).where("reason <> ''")
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("e10_well_covered_date", ", c AS (SELECT date, count(*) AS n FROM long_prices GROUP BY 1) SELECT coalesce((SELECT max(date) FROM c WHERE n >= greatest(5, floor(0.5 * (SELECT max(n) FROM c)))), (SELECT max(date) FROM c)) AS date")
def e10(spark, d):
    return R.well_covered_date(A.long_prices(spark, d), "date", least=5)


@query("e11_degraded_ids", "SELECT ric, count(*) AS obs FROM long_prices WHERE date >= (SELECT max(date) FROM long_prices) - INTERVAL 9 DAY GROUP BY 1 HAVING count(*) BETWEEN 1 AND 2 AND count(DISTINCT close) = 1")
def e11(spark, d):
    p = A.long_prices(spark, d)
    last = p.agg(F.max("date").alias("last"))
    recent = p.join(F.broadcast(last)).where(F.col("date") >= F.date_sub("last", 9))
    return recent.groupBy("ric").agg(F.count("*").alias("obs"), F.count_distinct("close").alias("closes")).where("obs between 1 and 2 and closes = 1").select("ric", "obs")


@query("e12_histogram", ", b AS (SELECT cast(least(floor((balance + 1000) / 11000 * 11), 10) AS INTEGER) AS bin, count(*) AS n FROM registry WHERE balance BETWEEN -1000 AND 10000 GROUP BY 1) SELECT cast(g.i AS INTEGER) AS bin, coalesce(b.n, 0) AS n FROM range(11) g(i) LEFT JOIN b ON b.bin = g.i")
def e12(spark, d):
    return R.histogram(A.registry(spark, d), "balance", 11, -1000.0, 10000.0)


@query("e17_field_coverage", ", u AS (SELECT as_of_date, ric, CASE WHEN status <> 'P' THEN 1.0 ELSE 0 END AS ok, 'cap' AS field FROM fundamentals UNION ALL SELECT as_of_date, ric, CASE WHEN priority <> '5-LOW' THEN 1.0 ELSE 0 END, 'priority' FROM fundamentals), t AS (SELECT field, avg(ok)*100 AS row_pct FROM u GROUP BY 1), dd AS (SELECT field, avg(p) AS date_pct, min(p) AS worst FROM (SELECT field, as_of_date, avg(ok)*100 AS p FROM u GROUP BY 1, 2) GROUP BY 1), k AS (SELECT field, avg(p) AS ticker_pct, quantile_cont(p, 0.1) AS p10 FROM (SELECT field, ric, avg(ok)*100 AS p FROM u GROUP BY 1, 2) GROUP BY 1) SELECT field, round(row_pct, 6) AS row_pct, round(date_pct, 6) AS date_pct, round(worst, 6) AS worst, round(ticker_pct, 6) AS ticker_pct, round(p10, 6) AS p10, round(0.4*row_pct + 0.4*date_pct + 0.2*ticker_pct, 6) AS score, 0.4*row_pct + 0.4*date_pct + 0.2*ticker_pct < 80 AS low FROM t JOIN dd USING (field) JOIN k USING (field)")
def e17(spark, d):
    f = A.fundamentals(spark, d)
    cells = f.select("as_of_date", "ric", F.expr("stack(2, 'cap', status <> 'P', 'priority', priority <> '5-LOW') as (field, ok)")).withColumn("ok", F.col("ok").cast("double"))
    share = lambda by: cells.groupBy("field", by).agg((F.avg("ok") * 100).alias("p"))
    rows = cells.groupBy("field").agg((F.avg("ok") * 100).alias("row_pct"))
    days = share("as_of_date").groupBy("field").agg(F.avg("p").alias("date_pct"), F.min("p").alias("worst"))
    ids = share("ric").groupBy("field").agg(F.avg("p").alias("ticker_pct"), F.percentile("p", 0.1).alias("p10"))
    score = 0.4 * F.col("row_pct") + 0.4 * F.col("date_pct") + 0.2 * F.col("ticker_pct")
    return rows.join(days, "field").join(ids, "field").select("field", *[r6(c).alias(c) for c in ("row_pct", "date_pct", "worst", "ticker_pct", "p10")], r6(score).alias("score"), (score < 80).alias("low"))


@query("e18_price_bounds", "SELECT r.country, min(b.lo) AS first, max(b.hi) AS last FROM (SELECT ric, min(date) AS lo, max(date) AS hi FROM prices GROUP BY 1) b JOIN registry r USING (ric) GROUP BY 1")
def e18(spark, d):
    b = A.prices(spark, d).groupBy("ric").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return b.join(A.registry(spark, d), "ric").groupBy("country").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))


@query("e19_status_counts", "SELECT status, count(*) AS n FROM fundamentals GROUP BY 1")
def e19(spark, d):
    return A.fundamentals(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("e20_coverage_breakdown", ", b AS (SELECT CASE WHEN p.price IS NULL THEN 'missing_price' WHEN p.price < 950 THEN 'missing_cpar_fit' ELSE 'covered' END AS coverage, abs(h.quantity * p.price) AS gross FROM holdings h LEFT JOIN parts p USING (ric)) SELECT k.coverage, count(b.coverage) AS n, round(coalesce(sum(b.gross), 0), 2) AS gross FROM (VALUES ('covered'), ('missing_price'), ('missing_cpar_fit'), ('insufficient_history')) k(coverage) LEFT JOIN b USING (coverage) GROUP BY 1")
def e20(spark, d):
    kinds = spark.createDataFrame([("covered",), ("missing_price",), ("missing_cpar_fit",), ("insufficient_history",)], "coverage string")
    label = F.when(F.col("price").isNull(), "missing_price").when(F.col("price") < 950, "missing_cpar_fit").otherwise("covered")
    rows = A.holdings(spark, d).join(A.parts(spark, d), "ric", "left").select(label.alias("coverage"), F.abs(F.col("quantity") * F.col("price")).alias("gross"))
    sums = rows.groupBy("coverage").agg(F.count("*").alias("n"), F.sum("gross").alias("gross"))
    return kinds.join(sums, "coverage", "left").select("coverage", F.coalesce("n", F.lit(0)).alias("n"), sql_round(F.coalesce("gross", F.lit(0.0)), 2).alias("gross"))


@query("e22_table_stats", "SELECT count(*) AS n, count(DISTINCT ric) AS ids, min(as_of_date) AS first, max(as_of_date) AS last, max(seq) AS last_job FROM fundamentals")
def e22(spark, d):
    return A.fundamentals(spark, d).agg(F.count("*").alias("n"), F.count_distinct("ric").alias("ids"), F.min("as_of_date").alias("first"), F.max("as_of_date").alias("last"), F.max("seq").alias("last_job"))


@query("e23_run_summary", "SELECT ric, CASE max(CASE status WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'running' ELSE 'completed' END AS overall, min(as_of_date) AS started, max(as_of_date) AS finished, date_diff('day', min(as_of_date), max(as_of_date)) AS days FROM fundamentals GROUP BY 1")
def e23(spark, d):
    level = F.max(F.when(F.col("status") == "F", 3).when(F.col("status") == "P", 2).otherwise(1))
    rows = A.fundamentals(spark, d).groupBy("ric").agg(level.alias("level"), F.min("as_of_date").alias("started"), F.max("as_of_date").alias("finished"))
    overall = F.when(F.col("level") == 3, "failed").when(F.col("level") == 2, "running").otherwise("completed")
    return rows.select("ric", overall.alias("overall"), "started", "finished", F.datediff("finished", "started").cast("long").alias("days"))


@query("e24_distinct_dates", "SELECT DISTINCT date FROM long_prices")
def e24(spark, d):
    return A.long_prices(spark, d).select("date").distinct()


@query("e25_pivot_last", "SELECT ric, arg_max(seq, (as_of_date, seq)) FILTER (WHERE status = 'F') AS f, arg_max(seq, (as_of_date, seq)) FILTER (WHERE status = 'O') AS o, arg_max(seq, (as_of_date, seq)) FILTER (WHERE status = 'P') AS p FROM fundamentals GROUP BY 1")
def e25(spark, d):
    """The list of values is given, so the pivot needs no extra pass."""
    wide = A.fundamentals(spark, d).groupBy("ric").pivot("status", ["F", "O", "P"]).agg(F.max_by("seq", F.struct("as_of_date", "seq")))
    return wide.select("ric", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("i01_multi_key_order", "SELECT account, ric, quantity, row_number() OVER (ORDER BY abs(quantity) DESC, account, ric) AS place FROM holdings ORDER BY abs(quantity) DESC, account, ric LIMIT 100")
def i01(spark, d):
    top = A.holdings(spark, d).orderBy(F.desc(F.abs("quantity")), "account", "ric").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("quantity")), "account", "ric")).cast("long"))


@query("i02_market_first", "SELECT r_name AS factor, row_number() OVER (ORDER BY r_name <> 'EUROPE', r_name) AS place FROM region")
def i02(spark, d):
    return A.read(spark, d, "region").select(F.col("r_name").alias("factor"), F.row_number().over(Window.orderBy(F.col("r_name") != "EUROPE", "r_name")).cast("long").alias("place"))


@query("i03_top_deltas", ", x AS (SELECT sector, sum(quantity) AS delta FROM holdings JOIN parts USING (ric) GROUP BY 1) SELECT sector, cast(delta AS BIGINT) AS delta FROM x ORDER BY abs(delta) DESC, sector LIMIT 20")
def i03(spark, d):
    x = A.holdings(spark, d).join(A.parts(spark, d), "ric").groupBy("sector").agg(F.sum("quantity").alias("delta"))
    return x.orderBy(F.desc(F.abs("delta")), "sector").limit(20)


@query("i04_ranked_search", ", x AS (SELECT ric, name, CASE WHEN upper(ric) = '12' THEN 0 WHEN starts_with(upper(ric), '12') THEN 1 WHEN contains(upper(ric), '12') THEN 2 WHEN contains(upper(name), '12') THEN 3 END AS rank FROM parts) SELECT ric, name, rank FROM x WHERE rank IS NOT NULL ORDER BY rank, ric LIMIT 50")
def i04(spark, d):
    return R.ranked_search(A.parts(spark, d), "ric", "name", "12", 50).select("ric", "name", "rank")


TERMS = ["12", "1", "RED", "widget", "mall g", "e b", "brand#2", "zzz", "2-BR"]


@query("i04b_indexed_search", ", t AS (SELECT unnest(['12', '1', 'RED', 'WIDGET', 'MALL G', 'E B', 'BRAND#2', 'ZZZ', '2-BR']) AS term), x AS (SELECT term, ric, name, CASE WHEN ric = term THEN 0 WHEN starts_with(ric, term) THEN 1 WHEN contains(ric, term) THEN 2 WHEN contains(upper(name), term) THEN 3 END AS rank FROM (SELECT ric || '-' || sector AS ric, name FROM (SELECT upper(ric) AS ric, upper(sector) AS sector, name FROM parts)) CROSS JOIN t) SELECT term, ric, name, rank FROM x WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank, ric) <= 50")
def i04b(spark, d):
    """The 50 best of several terms, found by trigrams and, for the shortest terms, by a scan."""
    rows = A.parts(spark, d).select(F.upper(F.concat_ws("-", "ric", "sector")).alias("ric"), "name")
    root, out = T.build_index(rows, ["ric", "name"]), None
    for term in TERMS:
        found = T.indexed_search(spark, root, "ric", "name", term, 50).select(F.lit(term.upper()).alias("term"), "ric", "name", "rank")
        out = found if out is None else out.unionByName(found)
    return out


@query("i05_last_n_dates", "SELECT ric, date FROM prices QUALIFY dense_rank() OVER (ORDER BY date DESC) <= 3")
def i05(spark, d):
    p = A.prices(spark, d)
    return p.join(F.broadcast(p.select("date").distinct().orderBy(F.desc("date")).limit(3)), "date", "left_semi").select("ric", "date")


@query("i06_union_ids", "SELECT ric FROM prices UNION SELECT ric FROM fundamentals")
def i06(spark, d):
    return A.prices(spark, d).select("ric").union(A.fundamentals(spark, d).select("ric")).distinct()


@query("i07_intersect_dates", "SELECT date FROM long_prices INTERSECT SELECT as_of_date FROM fundamentals")
def i07(spark, d):
    return A.long_prices(spark, d).select("date").intersect(A.fundamentals(spark, d).select("as_of_date"))


@query("i08_dates_to_compute", "SELECT DISTINCT date FROM long_prices EXCEPT SELECT as_of_date FROM fundamentals")
def i08(spark, d):
    p = A.long_prices(spark, d).select("date").distinct()
    return p.join(A.fundamentals(spark, d).select(F.col("as_of_date").alias("date")), "date", "left_anti")


@query("i09_precedence_union", ", u AS (SELECT ric, 0 AS p FROM prices UNION ALL SELECT ric, 1 FROM registry UNION ALL SELECT ric, 2 FROM fundamentals) SELECT ric, min(p) AS p FROM u GROUP BY 1")
def i09(spark, d):
    frames = [A.prices(spark, d), A.registry(spark, d), A.fundamentals(spark, d)]
    rows = [f.select("ric", F.lit(i).alias("p")) for i, f in enumerate(frames)]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("ric").agg(F.min("p").alias("p"))
