"""Queries for books of the weekly family: fits, loadings, covariance and prices are those of the long panel's last 52 weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from ..operators import timeseries as T
from ..operators import weekly as K
from ..operators import weeklybook as B
from ..sources import adapters as A
from ..sources.sinks import stored
from . import weekly_queries as W
from .catalog import query

#: Fixed value: weeks that a fit needs.
LEAST_WEEKS = 39


def r6(c):
    return sql_round(c, 6)


def r9(c):
    return sql_round(c, 9)


def book_positions(spark, d):
    """(account, ric, quantity): a customer's nation is an account, a supplier a security; returned items are short."""
    orders = A.read(spark, d, "orders").join(A.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("string").alias("account"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    rows = A.read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("account", F.col("l_suppkey").cast("string").alias("ric")).agg(F.sum(signed).alias("quantity"))


def fits(panel):
    """(ric, fit_status, use_status, specific_variance) of each security's line on the market."""
    rows = K.orthogonalized(panel.where("cast(ric as int) > 9"), "ric", "ret", "market", "weight")
    own = rows.groupBy("ric").agg((F.sum(F.col("weight") * F.col("residual") * F.col("residual")) / F.sum("weight")).alias("specific_variance"), F.count("*").alias("n"))
    return own.select("ric", F.when(F.col("n") < LEAST_WEEKS, "insufficient_history").otherwise("ok").alias("fit_status"), F.lit(None).cast("string").alias("use_status"), "specific_variance")


def loadings(panel):
    """(ric, factor_id, loading): the market beta, and betas on residual factors of at least 0.05."""
    rows = stored(W.univariate_of(panel), "univariate")
    own = rows.groupBy("ric").agg(F.max("market_beta").alias("loading")).select("ric", F.lit(W.MARKET).alias("factor_id"), "loading")
    return own.unionByName(rows.select("ric", "factor_id", F.when(F.abs("beta") < K.LEAST_LOADING, 0.0).otherwise(F.col("beta")).alias("loading")))


def trade_loadings(panel):
    lines = K.weighted_line(W.factors_of(panel), ["factor_id"], "ret", "market", "weight")
    return stored(K.trade_loadings(W.univariate_of(panel), lines, "ric", W.MARKET), "trade")


def covariance(panel):
    """Of the weekly returns of the market and the eight factors."""
    rows = panel.where("cast(ric as int) <= 9").withColumn("factor_id", F.concat(F.lit("F"), "ric"))
    return stored(K.weighted_covariance(rows, "ret", "weight"), "covariance")


def factors(spark):
    rows = [(W.MARKET, "market", 1), *[(f, g, int(f[1:])) for f, g in W.GROUPS.items()]]
    return spark.createDataFrame(rows, "factor_id string, family string, place int")


def prices(spark, d):
    """(ric, price): closes of the package's week, the last of the market's."""
    closes = T.weekly_close(A.long_prices(spark, d), False)
    last = closes.where("ric = '1'").groupBy().agg(F.max("week").alias("week"))
    # One row.
    return closes.join(F.broadcast(last), "week").select("ric", F.col("close").alias("price"))


def panel_of(spark, d):
    """The weekly panel, written: a package's fits, loadings and covariance all come from it."""
    return stored(W.panel(spark, d), "panel")


def rows_of(spark, d, panel, positions=None):
    return stored(B.position_rows(book_positions(spark, d) if positions is None else positions, fits(panel), prices(spark, d)), "positions")


def measured(spark, d, positions=None):
    """Positions, their parts, the books' metrics and specific variances."""
    panel = panel_of(spark, d)
    rows = rows_of(spark, d, panel, positions)
    each, idio = stored(B.parts(rows, loadings(panel)), "parts"), B.specific(rows)
    return rows, each, stored(B.factor_metrics(B.book_loadings(each), covariance(panel), idio), "metrics"), idio


BOOK = (
    W.TRADE
    + ", thr AS (SELECT ric, 'F1' AS factor_id, max(market_beta) AS loading FROM uni GROUP BY 1 UNION ALL SELECT ric, factor_id, CASE WHEN abs(beta) < 5e-2 THEN 0 ELSE beta END FROM uni)"
    + f", tl AS ({W.line('ret', 'market', 'ric', 'tgt')}), fit AS (SELECT t.ric, sum(weight * pow(ret - alpha - beta * market, 2)) / sum(weight) AS sv, CASE WHEN count(*) < 39 THEN 'insufficient_history' ELSE 'ok' END AS fit_status FROM tgt t JOIN tl USING (ric) GROUP BY 1)"
    + ", px AS (SELECT ric, close AS price FROM wk WHERE week = (SELECT max(week) FROM wk WHERE ric = '1'))"
    + ", fc AS (SELECT *, 'F' || ric AS factor_id FROM panel WHERE cast(ric AS INTEGER) <= 9)"
    + W.COV.format(x="ret", s="fc").split(", own AS")[0]
    + ", fs AS (SELECT DISTINCT factor_id, CASE WHEN factor_id = 'F1' THEN 'market' WHEN factor_id < 'F7' THEN 'sector' ELSE 'style' END AS family, cast(substr(factor_id, 2) AS INTEGER) AS place FROM fc)"
    + ", bk0 AS (SELECT cast(c_nationkey AS VARCHAR) AS account, cast(l_suppkey AS VARCHAR) AS ric, cast(sum(CASE WHEN l_returnflag = 'R' THEN -cast(l_quantity AS BIGINT) ELSE cast(l_quantity AS BIGINT) END) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"
    + ", bk AS ({positions})"
    + ", ps0 AS (SELECT account, ric, quantity, price, quantity * price AS mv, sv, CASE WHEN fit_status IS NULL THEN 'missing_cpar_fit' WHEN price IS NULL THEN 'missing_price' WHEN fit_status <> 'ok' THEN fit_status ELSE 'covered' END AS coverage FROM bk LEFT JOIN fit USING (ric) LEFT JOIN px USING (ric))"
    + ", ps AS (SELECT *, CASE WHEN coverage = 'covered' THEN mv / nullif(sum(abs(mv)) FILTER (WHERE coverage = 'covered') OVER (PARTITION BY account), 0) END AS weight FROM ps0)"
    + ", pt AS (SELECT account, ric, weight, factor_id, weight * loading AS part FROM ps JOIN thr USING (ric) WHERE weight IS NOT NULL), bl AS (SELECT account, factor_id, sum(part) AS loading FROM pt GROUP BY 1, 2 HAVING abs(sum(part)) > 1e-12)"
    + ", sp AS (SELECT account, ric, weight * weight * sv AS s FROM ps WHERE abs(weight * weight * sv) > 1e-12), ids AS (SELECT account, sum(s) AS s FROM sp GROUP BY 1)"
    + ", me0 AS (SELECT a.account, a.factor_id, a.loading, sum(c * b.loading) AS adjustment, sqrt(greatest(max(c) FILTER (WHERE a.factor_id = b.factor_id), 0)) AS volatility FROM bl a JOIN cell ON cell.factor_id = a.factor_id JOIN bl b ON b.account = a.account AND b.factor_id = cell.factor_id_2 GROUP BY 1, 2, 3)"
    + ", me AS (SELECT me0.*, loading * adjustment AS contribution, sum(loading * adjustment) OVER (PARTITION BY me0.account) + coalesce(s, 0) AS total FROM me0 LEFT JOIN ids USING (account))"
)
EACH = BOOK.format(positions="SELECT * FROM bk0")
ALL = BOOK.format(positions="SELECT 'all_accounts' AS account, ric, cast(sum(quantity) AS BIGINT) AS quantity FROM bk0 GROUP BY 2 HAVING abs(sum(quantity)) > 1e-12")


@query("h11b_book_positions", EACH + " SELECT account, ric, quantity, round(mv, 4) AS market_value, coverage, round(weight, 9) AS weight FROM ps")
def h11b(spark, d):
    return rows_of(spark, d, panel_of(spark, d)).select("account", "ric", "quantity", sql_round("market_value", 4).alias("market_value"), "coverage", r9("weight").alias("weight"))


@query("h11c_factor_variance", EACH + " SELECT account, factor_id, round(loading, 6) AS loading, round(volatility, 6) AS volatility, round(adjustment, 9) AS adjustment, round(contribution, 9) AS contribution, round(contribution / total, 6) AS share FROM me")
def h11c(spark, d):
    metrics = measured(spark, d)[2]
    return metrics.select("account", "factor_id", r6("loading").alias("loading"), r6("volatility").alias("volatility"), r9("adjustment").alias("adjustment"), r9("contribution").alias("contribution"), r6("share").alias("share"))


CHART = " SELECT pp.account, pp.factor_id, family, place, n, round(coalesce(loading, 0), 6) AS loading, round(long_part, 6) AS long_part, round(short_part, 6) AS short_part, round(coalesce(loading * volatility, 0), 6) AS sensitivity, round(coalesce(contribution / total, 0), 6) AS share FROM (SELECT account, factor_id, count(*) AS n, sum(greatest(part, 0)) AS long_part, sum(least(part, 0)) AS short_part FROM pt WHERE abs(part) > 1e-12 GROUP BY 1, 2) pp JOIN fs USING (factor_id) LEFT JOIN me ON me.account = pp.account AND me.factor_id = pp.factor_id"


def charted(spark, d, positions=None):
    _, each, metrics, _ = measured(spark, d, positions)
    rounded = [r6(c).alias(c) for c in ("loading", "long_part", "short_part", "sensitivity", "share")]
    return B.chart(each, metrics, factors(spark)).select("account", "factor_id", "family", "place", "n", *rounded)


@query("h11d_factor_chart", EACH + CHART)
def h11d(spark, d):
    return charted(spark, d)


@query("h11e_factor_drilldown", EACH + " SELECT pt.account, pt.factor_id, ric, round(part, 9) AS part, round(part / weight, 6) AS loading, round(coalesce(part / weight * volatility, 0), 6) AS scaled_loading, round(coalesce(part * volatility, 0), 9) AS scaled_part, round(coalesce(part / weight * adjustment, 0), 9) AS adjusted_loading, round(coalesce(part * adjustment / total * 100, 0), 4) AS risk_percent FROM pt LEFT JOIN me USING (account, factor_id) WHERE abs(part) > 1e-12")
def h11e(spark, d):
    _, each, metrics, _ = measured(spark, d)
    rows = B.drilldown(each, metrics)
    return rows.select("account", "factor_id", "ric", r9("part").alias("part"), r6("loading").alias("loading"), r6("scaled_loading").alias("scaled_loading"), r9("scaled_part").alias("scaled_part"), r9("adjusted_loading").alias("adjusted_loading"), sql_round("risk_percent", 4).alias("risk_percent"))


FAMILIES = "sum({0}) FILTER (WHERE family = 'market') AS market, sum({0}) FILTER (WHERE family = 'sector') AS industry, sum({0}) FILTER (WHERE family = 'style') AS style"
NAMES = ["market", "industry", "style", "idio"]


def families_sql(value: str, idio: str, places: int) -> str:
    shares = ", ".join(f"round(coalesce({c}, 0) / (coalesce(market, 0) + coalesce(industry, 0) + coalesce(style, 0) + coalesce(idio, 0)) * 100, {places}) AS {c}" for c in NAMES)
    return f" SELECT account, {shares} FROM (SELECT account, {FAMILIES.format(value)} FROM me JOIN fs USING (factor_id) GROUP BY 1) FULL JOIN (SELECT account, {idio} AS idio FROM ids) USING (account)"


@query("h11f_risk_shares", EACH + families_sql("contribution", "s", 4))
def h11f(spark, d):
    _, _, metrics, idio = measured(spark, d)
    return B.risk_shares(metrics, idio, factors(spark)).select("account", *[sql_round(c, 4).alias(c) for c in NAMES])


@query("h11g_vol_scaled_shares", EACH + families_sql("abs(loading * volatility)", "sqrt(s)", 2))
def h11g(spark, d):
    _, _, metrics, idio = measured(spark, d)
    return B.vol_scaled_shares(metrics, idio, factors(spark))


@query("h11h_risk_mix", EACH + f", mx AS (SELECT account, ric, {FAMILIES.format('abs(part * adjustment)')} FROM pt JOIN me USING (account, factor_id) JOIN fs USING (factor_id) WHERE abs(part) > 1e-12 AND abs(part * adjustment) > 1e-12 GROUP BY 1, 2), mi AS (SELECT coalesce(mx.account, sp.account) AS account, coalesce(mx.ric, sp.ric) AS ric, coalesce(market, 0) AS market, coalesce(industry, 0) AS industry, coalesce(style, 0) AS style, coalesce(s, 0) AS idio FROM mx FULL JOIN sp ON sp.account = mx.account AND sp.ric = mx.ric) SELECT account, ric, " + ", ".join(f"round({c} / (market + industry + style + idio) * 100, 4) AS {c}" for c in NAMES) + " FROM mi WHERE market + industry + style + idio > 1e-12")
def h11h(spark, d):
    _, each, metrics, idio = measured(spark, d)
    return B.risk_mix(each, metrics, idio, factors(spark)).select("account", "ric", *[sql_round(c, 4).alias(c) for c in NAMES])


SNAPSHOT = ", co AS (SELECT account, count(*) AS n, count(*) FILTER (WHERE coverage = 'covered') AS covered_n, coalesce(sum(abs(mv)), 0) AS gross, coalesce(sum(mv) FILTER (WHERE coverage = 'covered'), 0) AS net, coalesce(sum(abs(mv)) FILTER (WHERE coverage = 'covered'), 0) AS cg FROM ps GROUP BY 1), fv AS (SELECT account, sum(contribution) AS v FROM me GROUP BY 1) SELECT account, CASE WHEN cg <= 0 THEN 'unavailable' WHEN covered_n < n THEN 'partial' ELSE 'ok' END AS status, CASE WHEN cg <= 0 THEN 'nothing_covered' WHEN covered_n < n THEN 'some_excluded' END AS reason, n, covered_n, n - covered_n AS excluded_n, round(gross, 2) AS gross, round(net, 2) AS net, round(cg / nullif(gross, 0), 6) AS coverage_ratio, round(coalesce(v, 0), 9) AS factor_variance, round(coalesce(s, 0), 9) AS idio_variance, round(coalesce(v, 0) + coalesce(s, 0), 9) AS total_variance FROM co LEFT JOIN fv USING (account) LEFT JOIN ids USING (account)"


def snapshot(spark, d, positions=None):
    rows, _, metrics, idio = measured(spark, d, positions)
    out = B.snapshots(rows, metrics, idio)
    return out.select("account", "status", "reason", "n", "covered_n", "excluded_n", sql_round("gross", 2).alias("gross"), sql_round("net", 2).alias("net"), r6("coverage_ratio").alias("coverage_ratio"), *[r9(c).alias(c) for c in ("factor_variance", "idio_variance", "total_variance")])


@query("h12b_book_snapshots", EACH + SNAPSHOT)
def h12b(spark, d):
    return snapshot(spark, d)


@query("h12c_aggregate_snapshot", ALL + SNAPSHOT)
def h12c(spark, d):
    """All accounts as one book."""
    return snapshot(spark, d, B.all_accounts(book_positions(spark, d)))


@query("h12d_aggregate_chart", ALL + CHART)
def h12d(spark, d):
    return charted(spark, d, B.all_accounts(book_positions(spark, d)))


# Correlated factors aren't pruned in this SQL, which holds as no two of these factors come near the limit; tests have pairs that do.
HEDGE = EACH + ", ca AS (SELECT trade.*, abs(loading) AS size FROM trade JOIN fit USING (ric) WHERE fit_status = 'ok' AND abs(loading) >= CASE WHEN factor_id = 'F1' THEN 1e-1 ELSE 5e-2 END), lg AS (SELECT ric, 'market_neutral' AS mode, factor_id, -loading AS weight FROM ca WHERE factor_id = 'F1' UNION ALL SELECT ric, 'factor_neutral', factor_id, -loading FROM (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY ric ORDER BY factor_id <> 'F1', size DESC, factor_id) <= 5))"
AFTER = HEDGE + ", af AS (SELECT t.ric, m.mode, t.factor_id, t.loading AS before, coalesce(weight, 0) AS leg, t.loading + coalesce(weight, 0) AS after FROM trade t CROSS JOIN (SELECT unnest(['market_neutral', 'factor_neutral']) AS mode) m LEFT JOIN lg ON lg.ric = t.ric AND lg.mode = m.mode AND lg.factor_id = t.factor_id)"


@query("n15b_hedge_previews", AFTER + ", va AS (SELECT a.ric, a.mode, sum(a.before * c * b.before) AS vb, sum(a.after * c * b.after) AS va FROM af a JOIN cell ON cell.factor_id = a.factor_id JOIN af b ON b.ric = a.ric AND b.mode = a.mode AND b.factor_id = factor_id_2 GROUP BY 1, 2), re AS (SELECT ric, mode, sum(abs(leg)) AS gross, sum(leg) AS net, count(*) FILTER (WHERE leg <> 0) AS legs, CASE WHEN mode = 'market_neutral' OR sum(abs(before)) FILTER (WHERE factor_id <> 'F1') <= 0 OR NOT bool_or(abs(before) >= CASE WHEN factor_id = 'F1' THEN 1e-1 ELSE 5e-2 END) THEN 1 ELSE greatest(0, 1 - sum(abs(after)) FILTER (WHERE factor_id <> 'F1') / sum(abs(before)) FILTER (WHERE factor_id <> 'F1')) END AS cut FROM af GROUP BY 1, 2) SELECT ric, mode, CASE WHEN fit_status <> 'ok' THEN 'hedge_unavailable' WHEN cut >= 5e-1 THEN 'hedge_ok' ELSE 'hedge_degraded' END AS status, CASE WHEN fit_status <> 'ok' THEN 'fit_status_' || fit_status WHEN mode = 'market_neutral' AND legs = 0 THEN 'below_market_materiality_threshold' WHEN mode = 'factor_neutral' AND legs = 0 THEN 'no_material_factor_exposures' WHEN cut < 5e-1 THEN 'residual_factor_exposures_remain_after_pruning' END AS reason, round(CASE WHEN fit_status = 'ok' THEN cut END, 6) AS reduction, round(gross, 6) AS gross, round(net, 6) AS net, round(vb, 9) AS variance_before, round(va, 9) AS variance_after FROM re JOIN va USING (ric, mode) JOIN fit USING (ric)")
def n15b(spark, d):
    panel = panel_of(spark, d)
    _, previews = B.hedges(trade_loadings(panel), covariance(panel), W.MARKET, fits(panel))
    return previews.select("ric", "mode", "status", "reason", *[r6(c).alias(c) for c in ("reduction", "gross", "net")], r9("variance_before").alias("variance_before"), r9("variance_after").alias("variance_after"))


@query("n15c_hedged_loadings", AFTER + " SELECT ric, mode, factor_id, round(before, 6) AS before, round(leg, 6) AS leg, round(after, 6) AS after FROM af")
def n15c(spark, d):
    panel = panel_of(spark, d)
    rows = trade_loadings(panel)
    legs, _ = B.hedges(rows, covariance(panel), W.MARKET, fits(panel))
    return B.hedged_loadings(rows, legs).select("ric", "mode", "factor_id", *[r6(c).alias(c) for c in ("before", "leg", "after")])


@query("n15d_position_trades", HEDGE + " SELECT account, ric, mode, factor_id, round(weight * s, 6) AS weight, round(weight * mv, 2) AS notional, round(weight * mv / price, 4) AS trade_quantity FROM (SELECT account, ric, mv, sign(mv) AS s FROM ps WHERE coverage = 'covered' AND mv <> 0) JOIN lg USING (ric) LEFT JOIN (SELECT 'F' || ric AS factor_id, price FROM px) USING (factor_id)")
def n15d(spark, d):
    """Each factor's proxy is priced by its own security."""
    panel = panel_of(spark, d)
    legs, _ = B.hedges(trade_loadings(panel), covariance(panel), W.MARKET, fits(panel))
    proxies = prices(spark, d).select(F.concat(F.lit("F"), "ric").alias("factor_id"), "price")
    out = B.position_trades(rows_of(spark, d, panel), legs, proxies)
    return out.select("account", "ric", "mode", "factor_id", r6("weight").alias("weight"), sql_round("notional", 2).alias("notional"), sql_round("trade_quantity", 4).alias("trade_quantity"))


@query("n15e_security_details", EACH + ", su AS (SELECT cast(s_suppkey AS VARCHAR) AS ric, s_name AS display_name FROM supplier), cn AS (SELECT ric, count(*) AS n FROM thr WHERE abs(loading) > 1e-12 GROUP BY 1) SELECT ric, coalesce(display_name, ric) AS display_name, CASE WHEN fit_status IS NULL THEN 'registry' ELSE 'active_package' END AS source, CASE WHEN fit_status IS NULL THEN 'registry_only' WHEN fit_status = 'ok' THEN 'estimated' ELSE 'not_estimated' END AS tier, round(price, 6) AS price, coalesce(n, 0) AS loadings, fit_status IS NOT NULL AS can_be_staged FROM fit FULL JOIN su USING (ric) LEFT JOIN px USING (ric) LEFT JOIN cn USING (ric)")
def n15e(spark, d):
    listed = A.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ric"), F.col("s_name").alias("display_name"))
    panel = panel_of(spark, d)
    out = B.security_details(fits(panel), prices(spark, d), listed, loadings(panel))
    return out.select("ric", "display_name", "source", "tier", r6("price").alias("price"), "loadings", "can_be_staged")
