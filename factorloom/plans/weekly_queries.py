"""Queries for the weekly proxy regressions. Security 1 of the long panel is the market, 2 to 6 are sectors, 7 to 9 styles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from ..operators import portfolio as P
from ..operators import timeseries as T
from ..operators import weekly as K
from ..sources import adapters as A
from .catalog import query

MARKET = "F1"
GROUPS = {f"F{k}": "sector" if k < 7 else "style" for k in range(2, 10)}


def r6(c):
    return sql_round(c, 6)


def panel(spark, d):
    """(ric, week, ret, market, weight): weekly returns over the market's last 52 weeks."""
    closes = T.weekly_close(A.long_prices(spark, d), False)
    w = Window.partitionBy("ric").orderBy("week")
    returns = closes.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret is not null").select("ric", "week", "ret")
    market = returns.where("ric = '1'").orderBy(F.desc("week")).limit(52).select("week", F.col("ret").alias("market"))
    last = market.agg(F.max("week").alias("last"))
    # 52 rows at most.
    market = market.join(F.broadcast(last)).select("week", "market", K.decayed(F.datediff("last", "week") / 7).alias("weight"))
    return returns.join(F.broadcast(market), "week")


def factors_of(rows):
    return rows.where(F.col("ric").cast("int").between(2, 9)).withColumn("factor_id", F.concat(F.lit("F"), "ric"))


def factors(spark, d):
    return factors_of(panel(spark, d))


def univariate(spark, d):
    return univariate_of(panel(spark, d))


def univariate_of(both):
    """(ric, market_beta, factor_id, beta): each security's line on the market and on each residual factor."""
    rows = both.where("cast(ric as int) > 9")
    residuals = K.orthogonalized(factors_of(both), "factor_id", "ret", "market", "weight").select("week", "factor_id", "residual")
    betas = K.weighted_line(rows.join(residuals, "week"), ["ric", "factor_id"], "ret", "residual", "weight").select("ric", "factor_id", "beta")
    return betas.join(K.weighted_line(rows, ["ric"], "ret", "market", "weight").select("ric", F.col("beta").alias("market_beta")), "ric")


def line(y: str, x: str, by: str, source: str) -> str:
    beta = f"CASE WHEN sum(weight)*sum(weight*{x}*{x}) - sum(weight*{x})*sum(weight*{x}) > 0 THEN (sum(weight)*sum(weight*{x}*{y}) - sum(weight*{x})*sum(weight*{y})) / (sum(weight)*sum(weight*{x}*{x}) - sum(weight*{x})*sum(weight*{x})) ELSE 0 END"
    return f"SELECT {by}, (sum(weight*{y}) - ({beta})*sum(weight*{x})) / sum(weight) AS alpha, {beta} AS beta, count(*) AS n FROM {source} GROUP BY {by}"


PANEL = ", wk AS (SELECT ric, cast(date_trunc('week', date) AS DATE) + 4 AS week, arg_max(close, date) AS close FROM long_prices GROUP BY 1, 2), rt AS (SELECT ric, week, close / lag(close) OVER (PARTITION BY ric ORDER BY week) - 1 AS ret FROM wk), mk0 AS (SELECT week, ret AS market FROM rt WHERE ric = '1' AND ret IS NOT NULL ORDER BY week DESC LIMIT 52), mk AS (SELECT week, market, pow(5e-1, (date_diff('day', week, max(week) OVER ()) / 7e0) / 26e0) AS weight FROM mk0), panel AS (SELECT ric, week, ret, market, weight FROM rt JOIN mk USING (week) WHERE ret IS NOT NULL), fac AS (SELECT *, 'F' || ric AS factor_id FROM panel WHERE cast(ric AS INTEGER) BETWEEN 2 AND 9), tgt AS (SELECT * FROM panel WHERE cast(ric AS INTEGER) > 9)"
ORTH = PANEL + f", lines AS ({line('ret', 'market', 'factor_id', 'fac')}), res AS (SELECT fac.*, alpha, beta, ret - alpha - beta * market AS residual FROM fac JOIN lines USING (factor_id))"
UNI = ORTH + f", tr AS (SELECT t.ric, r.factor_id, t.ret, r.residual, t.weight FROM tgt t JOIN res r USING (week)), ub AS ({line('ret', 'residual', 'ric, factor_id', 'tr')}), um AS ({line('ret', 'market', 'ric', 'tgt')}), uni AS (SELECT ub.ric, ub.factor_id, ub.beta, um.beta AS market_beta FROM ub JOIN um USING (ric))"
TRADE = UNI + ", held AS (SELECT uni.*, lines.beta AS on_market FROM uni JOIN lines USING (factor_id)), trade AS (SELECT ric, 'F1' AS factor_id, max(market_beta) - sum(beta * on_market) AS loading FROM held GROUP BY 1 UNION ALL SELECT ric, factor_id, CASE WHEN abs(beta) < 5e-2 THEN 0 ELSE beta END FROM held)"


@query("g12_weighted_ols", PANEL + f" SELECT ric, round(alpha, 6) AS alpha, round(beta, 6) AS beta, n FROM ({line('ret', 'market', 'ric', 'panel')})")
def g12(spark, d):
    return K.weighted_line(panel(spark, d), ["ric"], "ret", "market", "weight").select("ric", r6("alpha").alias("alpha"), r6("beta").alias("beta"), "n")


@query("g13_market_orthogonalisation", ORTH + " SELECT factor_id, week, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(residual, 6) AS residual FROM res")
def g13(spark, d):
    rows = K.orthogonalized(factors(spark, d), "factor_id", "ret", "market", "weight")
    return rows.select("factor_id", "week", r6("alpha").alias("alpha"), r6("beta").alias("beta"), r6("residual").alias("residual"))


@query("g14_weighted_scores", PANEL + ", ms AS (SELECT factor_id, sum(weight*ret)/sum(weight) AS mean FROM fac GROUP BY 1), sc AS (SELECT factor_id, sqrt(sum(weight*(ret-mean)*(ret-mean))/sum(weight)) AS scale FROM fac JOIN ms USING (factor_id) GROUP BY 1) SELECT factor_id, week, round(mean, 6) AS mean, round(scale, 6) AS scale, round((ret-mean)/scale, 6) AS score FROM fac JOIN ms USING (factor_id) JOIN sc USING (factor_id) WHERE scale >= 1e-12")
def g14(spark, d):
    rows = K.weighted_scores(factors(spark, d), ["factor_id"], "ret", "weight")
    return rows.select("factor_id", "week", r6("mean").alias("mean"), r6("scale").alias("scale"), r6("score").alias("score"))


def fits(spark, d, two_step):
    residuals = K.orthogonalized(factors(spark, d), "factor_id", "ret", "market", "weight").select("week", "factor_id", "residual")
    return K.ridge_fits(panel(spark, d).where("cast(ric as int) > 9"), residuals, "ric", GROUPS, two_step=two_step)


@query("g15_one_shot_ridge")
def g15(spark, d):
    """Checked on planted coefficients."""
    return fits(spark, d, False)


@query("g16_two_step_ridge")
def g16(spark, d):
    """Checked on planted coefficients."""
    return fits(spark, d, True)


@query("g17_trade_loadings", TRADE + " SELECT ric, factor_id, round(loading, 6) AS loading FROM trade")
def g17(spark, d):
    lines = K.weighted_line(factors(spark, d), ["factor_id"], "ret", "market", "weight")
    return K.trade_loadings(univariate(spark, d), lines, "ric", MARKET).select("ric", "factor_id", r6("loading").alias("loading"))


COV = ", mean AS (SELECT factor_id, sum(weight*{x})/sum(weight) AS mean FROM {s} GROUP BY 1), cen AS (SELECT week, factor_id, weight, {x} - mean AS x FROM {s} JOIN mean USING (factor_id)), cell AS (SELECT a.factor_id, b.factor_id AS factor_id_2, sum(a.weight*a.x*b.x)/sum(a.weight) AS c FROM cen a JOIN cen b USING (week) GROUP BY 1, 2), own AS (SELECT factor_id, sqrt(greatest(c, 0)) AS v FROM cell WHERE factor_id = factor_id_2) SELECT cell.factor_id, factor_id_2, round(c, 6) AS covariance, round(CASE WHEN a.v*b.v > 0 THEN c/(a.v*b.v) ELSE 0 END, 6) AS correlation FROM cell JOIN own a ON a.factor_id = cell.factor_id JOIN own b ON b.factor_id = factor_id_2"


@query("g18_weighted_covariance", PANEL + COV.format(x="ret", s="fac"))
def g18(spark, d):
    return rounded(K.weighted_covariance(factors(spark, d), "ret", "weight"))


@query("g18b_residual_covariance", ORTH + COV.format(x="residual", s="res"))
def g18b(spark, d):
    return rounded(K.weighted_covariance(K.orthogonalized(factors(spark, d), "factor_id", "ret", "market", "weight"), "residual", "weight"))


def rounded(rows):
    return rows.select("factor_id", "factor_id_2", r6("covariance").alias("covariance"), r6("correlation").alias("correlation"))


@query("h18_display_weights", TRADE + ", hed AS (SELECT ric, factor_id, -loading AS weight FROM trade WHERE abs(loading) >= 5e-2), shown AS (SELECT factor_id AS of, ric AS p FROM (SELECT DISTINCT factor_id, substr(factor_id, 2) AS ric FROM hed)), pl AS (SELECT 'F' || ric AS of, 'F1' AS f, beta AS l FROM (SELECT ric, beta FROM (" + line("ret", "market", "ric", "fac") + "))) SELECT ric, factor_id, round(weight, 6) AS weight FROM (SELECT h.ric, coalesce(pl.f, h.factor_id) AS factor_id, sum(h.weight * coalesce(pl.l, 1)) AS weight FROM hed h LEFT JOIN pl ON pl.of = h.factor_id GROUP BY 1, 2) WHERE abs(weight) > 1e-12")
def h18(spark, d):
    """Each proxy's fit is its line on the market."""
    lines = K.weighted_line(factors(spark, d), ["factor_id"], "ret", "market", "weight")
    trade = K.trade_loadings(univariate(spark, d), lines, "ric", MARKET)
    hedges = trade.where(F.abs("loading") >= P.FACTOR_MATERIAL).select("ric", "factor_id", (-F.col("loading")).alias("weight"))
    proxies = hedges.select("factor_id").distinct().withColumn("proxy", F.substring("factor_id", 2, 9))
    shown = K.weighted_line(factors(spark, d), ["ric"], "ret", "market", "weight").select(F.col("ric").alias("proxy"), F.lit(MARKET).alias("factor_id"), F.col("beta").alias("loading"))
    return K.display_weights(hedges, proxies, shown, "ric").select("ric", "factor_id", r6("weight").alias("weight"))
