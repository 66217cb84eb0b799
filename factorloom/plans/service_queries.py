"""Queries for diagnostics by date, weekly histories, snapshots, scopes, searches, membership and package checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numbers import sql_round
from ..operators import crosssection as X
from ..operators import jobs as J
from ..operators import portfolio as P
from ..operators import relational as R
from ..operators import riskmodel as M
from ..operators import service as V
from ..sources import adapters as A
from ..sources import sinks as K
from . import kernel_queries as G
from . import portfolio_queries as H
from .catalog import query


def r6(c):
    return sql_round(c, 6)


def t_statistics(spark, d):
    """(date, factor_name, t): of each industry's mean return, and of the slope of returns on size and on value."""
    p = G.panel(spark, d)
    n = F.count("*")
    ind = p.groupBy("date", F.col("industry").alias("factor_name")).agg(n.alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")).where("n >= 3 and s > 0").select("date", "factor_name", (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"))
    c = p.groupBy("date").agg(n.alias("n"), F.corr("ret", "size").alias("Size"), F.corr("ret", "value").alias("Value")).where("n >= 3").unpivot(["date", "n"], ["Size", "Value"], "factor_name", "r")
    return ind.unionByName(c.select("date", "factor_name", (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t")))


TS = G.PANEL + ", ts AS (SELECT date, industry AS factor_name, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t FROM panel GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_samp(ret) > 0 UNION ALL SELECT date, 'Size', corr(ret, size) * sqrt((count(*) - 2) / (1 - corr(ret, size) * corr(ret, size))) FROM panel GROUP BY 1 HAVING count(*) >= 3 UNION ALL SELECT date, 'Value', corr(ret, value) * sqrt((count(*) - 2) / (1 - corr(ret, value) * corr(ret, value))) FROM panel GROUP BY 1 HAVING count(*) >= 3)"


@query("e13b_t_hit_rate", TS + " SELECT factor_name, round(avg(CASE WHEN abs(t) > 2 THEN 1.0 ELSE 0 END) * 100, 6) AS hit_rate FROM ts GROUP BY 1")
def e13b(spark, d):
    return V.hit_rate(t_statistics(spark, d)).select("factor_name", r6("hit_rate").alias("hit_rate"))


@query("e14b_t_breadth", TS + " SELECT date, round(avg(abs(t)) FILTER (WHERE factor_name IN ('Size', 'Value')), 6) AS style, round(avg(abs(t)) FILTER (WHERE factor_name NOT IN ('Size', 'Value')), 6) AS other FROM ts GROUP BY 1")
def e14b(spark, d):
    return V.breadth(t_statistics(spark, d), "date", F.col("factor_name").isin("Size", "Value")).select("date", r6("style").alias("style"), r6("other").alias("other"))


@query("e26b_exposure_turnover", G.PANEL + ", ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM panel)), cur AS (SELECT ds.date, p.ric, p.value, p.ret FROM panel p JOIN ds ON ds.date = p.date WHERE before IS NOT NULL), prv AS (SELECT ds.date, p.ric, p.value, p.ret FROM panel p JOIN ds ON ds.before = p.date), j AS (SELECT coalesce(a.date, b.date) AS date, abs(coalesce(a.value, 0) - coalesce(b.value, 0)) + abs(coalesce(a.ret, 0) - coalesce(b.ret, 0)) AS c FROM cur a FULL JOIN prv b ON a.date = b.date AND a.ric = b.ric), rw AS (SELECT j.date, sum(c) / (2 * count(*)) AS raw, greatest(1, date_diff('day', min(before), j.date)) AS days FROM j JOIN ds ON ds.date = j.date GROUP BY j.date), tu AS (SELECT *, raw / days AS turnover FROM rw) SELECT date, round(turnover, 6) AS turnover, round(CASE WHEN count(turnover) OVER l >= 3 THEN avg(turnover) OVER l ELSE turnover END, 6) AS roll60, round(raw, 6) AS raw_turnover, cast(days AS INTEGER) AS interval_days FROM tu WINDOW l AS (ORDER BY date ROWS 59 PRECEDING)")
def e26b(spark, d):
    cells = F.array(*[F.struct(F.lit(n).alias("factor_name"), F.col(c).alias("exposure")) for n, c in (("Value", "value"), ("Move", "ret"))])
    rows = V.exposure_turnover(G.panel(spark, d).select("date", "ric", F.inline(cells)), "date", "ric")
    return rows.select("date", *[r6(c).alias(c) for c in ("turnover", "roll60", "raw_turnover")], "interval_days")


@query("g19b_incremental_r2", G.G06 + ", fg AS (SELECT date, max(factor_return) FILTER (WHERE factor_name = 'Market') AS m, max(factor_return) FILTER (WHERE factor_name = 'Value') AS v FROM f GROUP BY 1), rs AS (SELECT p.date, p.ret, sqrt(p.cap) AS w, p.value * fg.v AS sf, p.ret - (fg.m + i.factor_return + p.value * fg.v) AS e FROM panel p JOIN fg USING (date) JOIN f i ON i.date = p.date AND i.factor_name = p.industry), av AS (SELECT date, sum(w * ret) / sum(w) AS mean FROM rs GROUP BY 1) SELECT rs.date, round(1 - sum(w * e * e) / sum(w * (ret - mean) * (ret - mean)), 6) AS full_r2, round(1 - sum(w * (e + sf) * (e + sf)) / sum(w * (ret - mean) * (ret - mean)), 6) AS structural_r2, round((sum(w * (e + sf) * (e + sf)) - sum(w * e * e)) / sum(w * (ret - mean) * (ret - mean)), 6) AS incremental_r2 FROM rs JOIN av USING (date) GROUP BY 1")
def g19b(spark, d):
    returns = G.simple_returns(spark, d)
    fitted = X.project_returns(G.exposures(spark, d), returns, "date", "ric")
    styles = returns.where("factor_name = 'Value'").select("date", F.col("factor_return").alias("v"))
    rows = G.panel(spark, d).join(fitted, ["date", "ric"]).join(styles, "date").withColumns({"residual": F.col("ret") - F.col("fitted"), "style_fitted": F.col("value") * F.col("v")})
    return V.block_r2(rows, "date", "ret", "cap", "residual", "style_fitted").select("date", *[r6(c).alias(c) for c in ("full_r2", "structural_r2", "incremental_r2")])


@query("n01_weekly_history", ", lp AS (SELECT *, lag(close, 3) OVER w AS l3, lag(close, 10) OVER w AS l10, close / lag(close) OVER w - 1 AS ret FROM long_prices WINDOW w AS (PARTITION BY ric ORDER BY date)), ss AS (SELECT max(date) AS date FROM long_prices GROUP BY date_trunc('week', date)), one AS (SELECT ric, as_of_date, max(seq) AS seq, arg_max(market_cap, seq) AS market_cap FROM fundamentals GROUP BY 1, 2), kn AS (SELECT b.ric, b.date, b.l3 / b.l10 - 1 AS momentum_raw, o.market_cap AS cap FROM (SELECT lp.* FROM lp JOIN ss USING (date)) b ASOF LEFT JOIN one o ON b.ric = o.ric AND b.date >= o.as_of_date), rw AS (SELECT kn.*, CASE WHEN cap > 0 THEN ln(cap) END AS size_raw, r.sector, r.country, concat_ws('|', CASE WHEN cap IS NULL OR cap <= 0 THEN 'missing_style' END, CASE WHEN cap IS NULL OR cap <= 0 THEN 'missing_market_cap' END) AS reasons FROM kn LEFT JOIN registry r USING (ric)), gd AS (SELECT *, median(size_raw) OVER (PARTITION BY date) AS med FROM rw WHERE reasons = ''), md AS (SELECT *, median(abs(size_raw - med)) OVER (PARTITION BY date) AS mad FROM gd), cl AS (SELECT *, CASE WHEN mad > 0 THEN least(greatest(size_raw, med - 3 * mad), med + 3 * mad) ELSE size_raw END AS x FROM md), st AS (SELECT *, sum(cap * x) OVER (PARTITION BY date) / sum(cap) OVER (PARTITION BY date) AS mean, stddev_pop(x) OVER (PARTITION BY date) AS sd FROM cl), zz AS (SELECT ric, date, least(greatest(CASE WHEN sd > 1e-12 THEN (x - mean) / sd ELSE 0 END, -5), 5) AS z FROM st) SELECT rw.ric, rw.date, rw.cap AS market_cap, round(momentum_raw, 6) AS momentum_raw, reasons, round(z, 4) AS size FROM rw LEFT JOIN zz ON zz.ric = rw.ric AND zz.date = rw.date")
def n01(spark, d):
    """Prices, fundamentals as of the session and the registry in one plan; momentum over 3 to 10 rows, as histories are short."""
    rows = V.weekly_history(A.long_prices(spark, d), A.fundamentals(spark, d), A.registry(spark, d), lag=3, long_lag=10)
    return rows.select("ric", "date", "market_cap", r6("momentum_raw").alias("momentum_raw"), "reasons", sql_round("size", 4).alias("size"))


#: Fundamentals of which the table has totals only: the rest is made of those.
FACTS = {
    "market_cap": "market_cap", "book_value": "market_cap / 1e3 - 20", "shares_outstanding": "seq % 7 + 1.0", "forward_eps": "market_cap / 1e4", "trailing_eps": "seq % 11 - 5.0", "operating_cashflow": "market_cap / 20 - 1000", "total_debt": "market_cap / 3 + seq % 101", "total_assets": "market_cap * 2 + seq % 13",
    "return_on_equity": "seq % 17 / 10.0", "gross_profit": "market_cap / 9 - seq % 19", "operating_margins": "0.25", "sales_growth_raw": "seq % 23 / 1e2", "eps_growth_raw": "seq % 29 / 1e2", "asset_growth_raw": "seq % 31 / 1e2", "dividend_yield_raw": "seq % 37 / 1e3", "beta_raw": "seq % 41 / 20.0",
}
SINGLES = {s: next(iter(p)) for s, p in X.STYLES.items() if len(p) == 1}
APART = {c: c for p in X.STYLES.values() if len(p) > 1 for c in p}


def section_sql() -> str:
    """Tables up to the scores of all 14 styles, and a last one that picks the columns."""
    out = ", lp AS (SELECT *, lag(close, 3) OVER w AS l3, lag(close, 10) OVER w AS l10, close / lag(close) OVER w - 1 AS ret FROM long_prices WINDOW w AS (PARTITION BY ric ORDER BY date)), pf AS (SELECT *, CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v END AS rv, CASE WHEN count(*) OVER a >= 10 THEN avg(close * volume) OVER a END AS adv, CASE WHEN count(*) OVER s >= 10 THEN avg(volume) OVER s END AS v21, CASE WHEN count(*) OVER y >= 60 THEN avg(volume) OVER y END AS v252 FROM lp WINDOW v AS (PARTITION BY ric ORDER BY date ROWS 62 PRECEDING), a AS (PARTITION BY ric ORDER BY date ROWS 19 PRECEDING), s AS (PARTITION BY ric ORDER BY date ROWS 20 PRECEDING), y AS (PARTITION BY ric ORDER BY date ROWS 251 PRECEDING))"
    out += ", ss AS (SELECT max(date) AS date FROM long_prices GROUP BY date_trunc('week', date)), one AS (SELECT ric, as_of_date, max(seq) AS seq, arg_max(market_cap, seq) AS market_cap FROM fundamentals GROUP BY 1, 2), fu AS (SELECT ric, as_of_date, " + ", ".join(f"{x} AS {c}" for c, x in FACTS.items()) + " FROM one)"
    out += ", kn AS (SELECT b.*, o.* EXCLUDE (ric, as_of_date), r.sector AS industry, r.country FROM (SELECT pf.* FROM pf JOIN ss USING (date)) b ASOF LEFT JOIN fu o ON b.ric = o.ric AND b.date >= o.as_of_date LEFT JOIN registry r ON r.ric = b.ric), eq AS (SELECT *, CASE WHEN book_value * shares_outstanding > 0 THEN book_value * shares_outstanding END AS equity, ln(greatest(market_cap, 1)) AS size_raw FROM kn)"
    raw = {
        "size_raw": "size_raw", "nonlinear_size_raw": "power(size_raw, 3)", "momentum_raw": "l3 / l10 - 1", "st_reversal_raw": "-(close / l3 - 1)", "resid_vol_raw": "rv", "log_avg_dollar_volume_20d_raw": "ln(greatest(adv, 1))", "book_to_price_raw": "book_value / nullif(close, 0)", "forward_ep_raw": "forward_eps / nullif(close, 0)",
        "trailing_ep_raw": "trailing_eps / nullif(close, 0)", "cash_earnings_yield_raw": "operating_cashflow / nullif(market_cap, 0)", "debt_to_equity_raw": "total_debt / equity", "debt_to_assets_raw": "total_debt / nullif(total_assets, 0)", "book_leverage_raw": "total_assets / equity", "roe_raw": "return_on_equity",
        "gross_profitability_raw": "coalesce(gross_profit / nullif(total_assets, 0), operating_margins)", "turnover_1m_raw": "v21 / nullif(shares_outstanding, 0)", "turnover_12m_raw": "v252 / nullif(shares_outstanding, 0)",
    } | {c: c for c in FACTS if c.endswith("_raw")}
    out += ", ra AS (SELECT date, ric, coalesce(market_cap, 0) AS cap, industry, coalesce(market_cap > 0 AND industry <> '' AND country <> '', false) AS core, " + ", ".join(f"{x} AS {c}" for c, x in raw.items()) + " FROM eq), rw AS (SELECT * FROM ra WHERE date IN (SELECT date FROM ra WHERE core GROUP BY 1 HAVING count(*) >= 30))"
    apart, here = G.style_steps("rw", APART, {}, "w")
    out += apart + ", sy AS (SELECT *, " + ", ".join(f"{' + '.join(f'{w} * {c}' for c, w in p.items()) if len(p) > 1 else next(iter(p))} AS {G.column_of(s)}" for s, p in X.STYLES.items()) + f" FROM {here})"
    scores, here = G.style_steps("sy", {s: G.column_of(s) for s in X.STYLES}, X.CONTROLS, "u")
    return out + scores + " SELECT date, ric, core, " + ", ".join(f"round({G.column_of(s)}, 4) AS {G.column_of(s)}" for s in X.STYLES) + f" FROM {here}"


@query("n01b_published_history", section_sql())
def n01b(spark, d):
    """Weekly cross-sections with all 14 styles, computed and committed in two goes, and read from the ledger."""
    facts = A.fundamentals(spark, d).select("ric", "as_of_date", "seq", *[F.expr(x).cast("double").alias(c) for c, x in FACTS.items()])
    raw = K.stored(V.raw_sections(A.long_prices(spark, d), facts, A.registry(spark, d), lag=3, long_lag=10), "raw")
    root = K.shared_folder(spark, "history")
    settings = {"method": "1", "literal": True}
    J.history_job(raw.where("date < '1996-01-01'"), root, settings, batch=10_000)
    J.history_job(raw, root, settings, batch=10_000)
    return J.table(spark, root, "sections").select("date", "ric", "core", *[sql_round(F.col(f"`{s}`"), 4).alias(G.column_of(s)) for s in X.STYLES])


DAILY = {"method": "1", "winsor": 0.01, "least": 30, "styles": ["Size", "Value"], "controls": {}}


def daily_ledger(spark, d):
    """The ledger of a job over the panel that was first run over half of its dates."""
    sections = K.stored(G.panel(spark, d).withColumnsRenamed({"size": "Size", "value": "Value"}).withColumn("core", F.lit(True)), "panel")
    root = K.shared_folder(spark, "daily")
    J.daily_returns_job(sections.where("dayofmonth(date) <= 15"), root, DAILY)
    J.daily_returns_job(sections, root, DAILY)
    return root


@query("n02b_daily_job", G.G05 + ", fu AS (SELECT date, min(date) FILTER (WHERE n >= 30) OVER () AS first, n FROM (SELECT date, count(*) AS n FROM panel GROUP BY 1)) SELECT fu.date, factor_name, round(b, 6) AS factor_return, round(se, 6) AS robust_se, fu.n AS rows_n FROM fu LEFT JOIN al USING (date) WHERE fu.date >= first")
def n02b(spark, d):
    """Factor returns beside the counts of eligible rows, which dates of too few rows have as well."""
    root = daily_ledger(spark, d)
    rows = J.table(spark, root, "eligibility").join(J.table(spark, root, "factor_returns"), "date", "left")
    return rows.select("date", "factor_name", r6("factor_return").alias("factor_return"), r6("robust_se").alias("robust_se"), "rows_n")


#: From the job's outputs to shares of risk: covariance, specific variances, exposures of the last date, books by the registry's scope.
CHAIN = (
    G.G05 + ", fr AS (SELECT date, factor_name, b AS factor_return FROM al)" + G.covariance_sql("fr")
    + ", sw AS (SELECT ric, date, industry AS sector, e, power(0.5, (row_number() OVER (PARTITION BY ric ORDER BY date DESC) - 1) / 126.0) AS w FROM er), sv AS (SELECT ric, count(*) AS obs, arg_max(sector, date) AS sector, greatest(sum(w * e * e) / sum(w) - power(sum(w * e) / sum(w), 2), 0) * 252 AS raw FROM sw GROUP BY 1 HAVING count(*) >= 2), so AS (SELECT median(raw) AS a FROM sv WHERE raw > 0), sx AS (SELECT sector, median(raw) AS b FROM sv GROUP BY 1), sr AS (SELECT ric, greatest(1e-8, least(1, obs / 80.0) * raw + (1 - least(1, obs / 80.0)) * (0.7 * b + 0.3 * a)) AS v FROM sv JOIN sx USING (sector) CROSS JOIN so)"
    ", bk AS (SELECT scope AS account, ric, round(balance / sum(abs(balance)) OVER (PARTITION BY scope), 6) AS weight FROM registry), le AS (SELECT * FROM er WHERE date = (SELECT max(date) FROM er)), ex AS (SELECT ric, 'Market' AS f, 1e0 AS x FROM le UNION ALL SELECT ric, industry, 1e0 FROM le UNION ALL SELECT ric, 'Size', s1 FROM le UNION ALL SELECT ric, 'Value', s2 FROM le), bx AS (SELECT account, f, sum(weight * x) AS x FROM bk JOIN ex USING (ric) GROUP BY 1, 2)"
    ", sp AS (SELECT account, sum(weight * weight * coalesce(v, 0)) AS s FROM bk LEFT JOIN sr USING (ric) GROUP BY 1), ck AS (SELECT *, CASE WHEN f = 'Market' THEN 'market' WHEN f IN ('Size', 'Value') THEN 'style' ELSE 'industry' END AS ka, CASE WHEN g = 'Market' THEN 'market' WHEN g IN ('Size', 'Value') THEN 'style' ELSE 'industry' END AS kb FROM cov)"
    ", cells AS (SELECT a.account, a.f, ka, kb, a.x * c * b.x AS p FROM bx a JOIN ck ON a.f = ck.f JOIN bx b ON b.account = a.account AND b.f = ck.g), by_k AS (SELECT account, ka, kb, sum(p) AS p FROM cells GROUP BY 1, 2, 3), own AS (SELECT account, ka AS k, greatest(p, 0) AS o FROM by_k WHERE ka = kb), dealt AS (SELECT account, k, o AS m FROM own UNION ALL SELECT y.account, y.ka, CASE WHEN abs(y.p) * 2 <= 1e-12 THEN 0 WHEN a.o + b.o <= 1e-12 THEN y.p ELSE 2 * y.p * a.o / (a.o + b.o) END FROM by_k y JOIN own a ON a.account = y.account AND a.k = y.ka JOIN own b ON b.account = y.account AND b.k = y.kb WHERE y.ka <> y.kb), cv AS (SELECT account, k AS category, greatest(sum(m), 0) AS variance FROM dealt GROUP BY 1, 2)"
)


def chain(spark, d):
    """(positions, books, covariance, specific variances) of books whose risk comes from the daily job's tables alone."""
    root = daily_ledger(spark, d)
    returns, residuals = J.table(spark, root, "factor_returns"), J.table(spark, root, "residuals")
    cov = K.stored(M.factor_covariance(returns.select("date", "factor_name", "factor_return")), "covariance")
    var = M.specific_risk(residuals.withColumnRenamed("industry", "sector")).select("ric", "specific_var")
    last = residuals.join(F.broadcast(residuals.agg(F.max("date").alias("date"))), "date")
    cell = lambda name, value: F.struct(name.alias("factor_name"), value.alias("exposure"))
    cells = F.array(cell(F.lit("Market"), F.lit(1.0)), cell(F.col("industry"), F.lit(1.0)), cell(F.lit("Size"), F.col("Size")), cell(F.lit("Value"), F.col("Value")))
    book = P.positions(A.registry(spark, d).select(F.col("scope").alias("account"), "ric", F.col("balance").alias("quantity")), A.registry(spark, d).select("ric", F.lit(1.0).alias("price")))
    return book, P.book_exposures(book, last.select("ric", F.inline(cells))), cov, P.specific_variance(book, var)


def chain_category(c):
    return F.when(c == "Market", "market").when(c.isin("Size", "Value"), "style").otherwise("industry")


@query("h03c_chain_shares", CHAIN + ", x AS (SELECT account, category, variance AS p FROM cv UNION ALL SELECT account, 'idio', s FROM sp) SELECT account, category, CASE WHEN sum(p) OVER (PARTITION BY account) > 1e-12 THEN round(p / sum(p) OVER (PARTITION BY account) * 100, 2) WHEN category = 'idio' THEN 100 ELSE 0 END AS share FROM x")
def h03c(spark, d):
    """Shares of risk of books, from prices to shares through the job's ledger."""
    _, books, cov, specific = chain(spark, d)
    return P.risk_shares(P.category_variance(P.quadratic_cells(books, cov), chain_category), specific)


@query("h08b_chain_correlations", CHAIN + " SELECT a.f AS factor_name, a.g AS factor_name_2, round(a.c / sqrt(b.c * e.c), 4) AS correlation FROM cov a JOIN cov b ON b.f = a.f AND b.g = a.f JOIN cov e ON e.f = a.g AND e.g = a.g")
def h08b(spark, d):
    return P.correlations(chain(spark, d)[2])


@query("n02_factor_return_dates", ", cn AS (SELECT date, count(*) AS n FROM long_prices GROUP BY 1), a AS (SELECT DISTINCT date FROM long_prices WHERE date < DATE '1996-01-01'), b AS (SELECT DISTINCT date FROM long_prices WHERE extract(dow FROM date) <> 3) SELECT date FROM cn WHERE date >= (SELECT min(date) FROM cn WHERE n >= 2) AND date NOT IN (SELECT date FROM a JOIN b USING (date))")
def n02(spark, d):
    """Sessions that either of two caches lacks, from the first that is usable."""
    p = A.long_prices(spark, d).select("date")
    caches = [p.where("date < '1996-01-01'"), p.where(F.dayofweek("date") != 4)]
    return V.dates_to_compute(p, caches, "date", p.groupBy("date").agg(F.count("*").alias("n")), 2)


def sections(spark, d):
    """Cross-sections of the registry's securities: dates of their fundamentals."""
    return A.fundamentals(spark, d).join(A.registry(spark, d).select("ric", "ticker"), "ric").select("ric", "ticker", "as_of_date")


@query("n03_snapshot_current", ", bs AS (SELECT ric, max(as_of_date) AS as_of_date FROM fundamentals JOIN registry USING (ric) WHERE as_of_date < DATE '1997-01-01' GROUP BY 1), fd AS (SELECT ric, max(as_of_date) AS fundamentals_date, arg_max(market_cap, (as_of_date, seq)) AS market_cap FROM fundamentals WHERE as_of_date <= (SELECT max(as_of_date) FROM bs) GROUP BY 1), pr AS (SELECT ric, max(date) AS prices_date, arg_max(close, date) AS close FROM long_prices WHERE date <= (SELECT max(as_of_date) FROM bs) GROUP BY 1) SELECT bs.ric, bs.as_of_date, fundamentals_date, market_cap, prices_date, round(close, 6) AS close FROM bs LEFT JOIN fd USING (ric) LEFT JOIN pr USING (ric)")
def n03(spark, d):
    return snapshots(spark, d, "current")


@query("n03b_snapshot_full", ", bs AS (SELECT DISTINCT ric, as_of_date FROM fundamentals JOIN registry USING (ric) WHERE as_of_date < DATE '1997-01-01'), fo AS (SELECT ric, as_of_date AS fundamentals_date, arg_max(market_cap, seq) AS market_cap FROM fundamentals GROUP BY 1, 2), x AS (SELECT bs.*, fundamentals_date, market_cap FROM bs ASOF LEFT JOIN fo ON bs.ric = fo.ric AND bs.as_of_date >= fo.fundamentals_date) SELECT x.*, p.date AS prices_date, round(p.close, 6) AS close FROM x ASOF LEFT JOIN long_prices p ON x.ric = p.ric AND x.as_of_date >= p.date")
def n03b(spark, d):
    return snapshots(spark, d, "full")


def snapshots(spark, d, mode):
    base = V.base_sections(sections(spark, d).where("as_of_date < '1997-01-01'"), mode)
    facts = {"fundamentals": (A.fundamentals(spark, d), "as_of_date", ["seq"], ["market_cap"]), "prices": (A.long_prices(spark, d), "date", ["volume"], ["close"])}
    # The fundamentals' own date has the base's name, so it is renamed before.
    facts["fundamentals"] = (facts["fundamentals"][0].withColumnRenamed("as_of_date", "known"), "known", ["seq"], ["market_cap"])
    return V.snapshot(base, facts, mode).select("ric", "as_of_date", "fundamentals_date", "market_cap", "prices_date", r6("close").alias("close"))


@query("n04_base_sections", " SELECT upper(ric) AS ric, upper(max(ticker)) AS ticker, max(as_of_date) AS as_of_date FROM fundamentals JOIN registry USING (ric) GROUP BY 1")
def n04(spark, d):
    return V.base_sections(sections(spark, d), "current")


SCOPES = ["identifier_refresh", "price_ingest", "returns_projection", "weekly_build", "pit_ingest"]


@query("n05_scopes", ", sc AS (SELECT ric || CASE cast(ric AS INTEGER) % 3 WHEN 0 THEN '.N' WHEN 1 THEN '.OQ' ELSE '.P' END AS ric, sector || cast(ric AS INTEGER) % 50 AS ticker, cast(ric AS INTEGER) AS n FROM registry WHERE cast(ric AS INTEGER) % 5 <> 0) SELECT 'identifier_refresh' AS scope, ric, ticker FROM sc UNION ALL SELECT 'price_ingest', ric, ticker FROM sc WHERE n % 7 <> 0 UNION ALL SELECT 'returns_projection', ric, ticker FROM sc WHERE n % 11 = 0 UNION ALL SELECT 'weekly_build', ric, ticker FROM sc WHERE n % 2 = 0 OR n % 3 = 0 UNION ALL SELECT 'pit_ingest', ric, ticker FROM sc WHERE n % 4 = 0 AND n % 11 <> 0 UNION ALL SELECT * FROM (SELECT 'pit_ingest', ric, ticker FROM sc WHERE n % 4 <> 0 AND n % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN ric LIKE '%.N' THEN 0 WHEN ric LIKE '%.OQ' THEN 1 WHEN ric LIKE '%.P' THEN 4 END, ric) = 1)")
def n05(spark, d):
    n = F.col("ric").cast("int")
    flag = lambda c: c.cast("int")
    rows = A.registry(spark, d).select(
        F.concat("ric", F.when(n % 3 == 0, ".N").when(n % 3 == 1, ".OQ").otherwise(".P")).alias("ric"), F.concat(F.upper("sector"), (n % 50).cast("string")).alias("ticker"), F.when(n % 5 == 0, "disabled").otherwise(" ").alias("tracking"), F.lit("New York").alias("exchange"),
        F.lit("master_seed").alias("source"), flag(n % 7 != 0).alias("price_enabled"), flag(n % 13 != 0).alias("pit_enabled"), F.lit(1).alias("equity"), flag(n % 4 != 0).alias("classified"), flag(n % 11 == 0).alias("projection"), flag(n % 2 == 0).alias("core"), flag(n % 3 == 0).alias("extended"), F.lit(0).alias("degraded"),
    )
    out = [V.scope(rows, s).select(F.lit(s).alias("scope"), "ric", "ticker") for s in SCOPES]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


@query("n06_policy_reconcile", ", x AS (SELECT cast(ric AS INTEGER) AS n FROM registry), k AS (SELECT n, CASE n % 5 WHEN 0 THEN 'desk' WHEN 1 THEN '' ELSE 'Registry_Seed_Defaults' END AS src, CASE WHEN n % 9 = 0 THEN 'projection_only' END AS role, CASE n % 4 WHEN 0 THEN 'fund_vehicle' WHEN 1 THEN 'single_name_equity' WHEN 2 THEN 'other' END AS kind, CASE n % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ex_us' END AS home, CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS single FROM x) SELECT cast(n AS VARCHAR) AS ric, 'registry_seed_defaults' AS policy_source, CASE WHEN role IS NOT NULL THEN '10000101' WHEN coalesce(kind, 'other') = 'other' AND home IS NULL AND single = 0 THEN '11110011' WHEN kind = 'fund_vehicle' THEN '10000101' WHEN single = 1 AND home IS NULL THEN '11110011' WHEN single = 1 AND home = 'us' THEN '11110011' WHEN single = 1 THEN '11101001' ELSE '10000001' END AS bits FROM k WHERE src <> 'desk'")
def n06(spark, d):
    """Default policies derived again, a desk's own left alone."""
    n = F.col("ric").cast("int")
    r = A.registry(spark, d)
    policies = r.select("ric", F.when(n % 5 == 0, "desk").when(n % 5 == 1, "").otherwise("Registry_Seed_Defaults").alias("policy_source"))
    kind = L.ladder((n % 4 == 0, "fund_vehicle"), (n % 4 == 1, "single_name_equity"), (n % 4 == 2, "other"))
    structure = r.select("ric", F.when(n % 9 == 0, "projection_only").alias("role"), kind.alias("kind"), L.ladder((n % 3 == 0, "us"), (n % 3 == 1, "ex_us")).alias("scope"), (n % 4 == 1).cast("int").alias("single"))
    out = V.reconciled_policies(policies, structure, ["registry_seed_defaults"])
    return out.select("ric", "policy_source", F.concat(*[F.col(f"flags.{c}").cast("string") for c in L.POLICY_FLAGS]).alias("bits"))


@query("n08_membership_lookup", ", lt AS (SELECT max(as_of_date) AS day FROM fundamentals WHERE as_of_date <= DATE '1996-06-30') SELECT ric, arg_max(status, seq) AS status FROM fundamentals WHERE as_of_date = (SELECT day FROM lt) GROUP BY 1")
def n08(spark, d):
    """Membership of the last date up to one asked for."""
    rows = A.fundamentals(spark, d)
    day = rows.where("as_of_date <= '1996-06-30'").agg(F.max("as_of_date").alias("as_of_date"))
    return R.latest_wide(rows.join(F.broadcast(day), "as_of_date"), ["ric"], ["seq"], ["status"]).select("ric", "status")


@query("n09_membership_coverage", ", mb AS (SELECT account, count(*) FILTER (WHERE cast(ric AS INTEGER) % 20 <> 0) AS matched, count(*) FILTER (WHERE cast(ric AS INTEGER) % 20 = 0) AS missing FROM holdings GROUP BY 1) SELECT *, missing <= 25 AND (missing <= 5 OR missing / (matched + missing) <= 5e-2) AS ok FROM mb")
def n09(spark, d):
    rows = A.holdings(spark, d)
    return V.membership_coverage(rows, rows.where(F.col("ric").cast("int") % 20 != 0), "account", "ric")


@query("n10_staged_payloads", " SELECT 'snap' AS snapshot, 'portfolio' AS name, count(*) AS n FROM holdings UNION ALL SELECT 'snap', 'universe', count(*) FROM registry")
def n10(spark, d):
    """Rows by payload of a staged snapshot."""
    rows = V.staged({"portfolio": A.holdings(spark, d), "universe": A.registry(spark, d)}, "snap")
    return rows.groupBy("snapshot", "name").agg(F.count("*").alias("n"))


@query("n10b_restamped_payloads", " SELECT 'snap-2' AS snapshot, 'portfolio' AS name, account, ric, cast(quantity AS VARCHAR) AS quantity, 'run-2' AS run_id, 'snap-2' AS snapshot_id FROM holdings UNION ALL SELECT 'snap-2', 'universe', NULL, ric, NULL, NULL, NULL FROM registry")
def n10b(spark, d):
    """Rows of a staged snapshot that is published again: the portfolio's stamp is replaced, the universe has none."""
    first = A.holdings(spark, d).withColumn("run_id", F.lit("run-1"))
    rows = V.staged({"portfolio": first, "universe": A.registry(spark, d)}, "snap-1")
    again = V.restamped(rows, {"portfolio": "account string, ric string, quantity long, run_id string"}, {"run_id": "run-2", "snapshot_id": "snap-2"}, "snap-2")
    fields = F.from_json("payload", "account string, ric string, quantity string, run_id string, snapshot_id string")
    return again.select("snapshot", "name", fields.alias("fields")).select("snapshot", "name", "fields.*")


@query("n13_factor_sections", G.PANEL + ", lt AS (SELECT * FROM panel WHERE date = (SELECT max(date) FROM panel)) SELECT industry, count(*) AS n, count(DISTINCT ric) AS rics, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM lt GROUP BY 1")
def n13(spark, d):
    p = G.panel(spark, d)
    last = p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date")
    return last.groupBy("industry").agg(F.count("*").alias("n"), F.count_distinct("ric").alias("rics"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"))


@query("n15_portfolio_hedge", H.W + H.LOADINGS.replace(", n AS", ", nn AS").replace("FROM n", "FROM nn") + ", bk AS (SELECT account, factor_name, sum(weight * loading * 10) AS x FROM w JOIN l USING (ric) GROUP BY 1, 2) SELECT account, factor_name, round(-x, 9) AS weight FROM bk WHERE abs(x) >= CASE WHEN factor_name = 'Market' THEN 1e-1 ELSE 5e-2 END QUALIFY row_number() OVER (PARTITION BY account ORDER BY abs(x) DESC, factor_name) <= 10")
def n15(spark, d):
    """Legs against a whole book's loadings, at ten times its gross value."""
    books = P.book_exposures(H.weighted(spark, d), H.loadings(spark, d).select("ric", "factor_name", (F.col("loading") * 10).alias("exposure")))
    return P.hedge_legs(books.withColumnRenamed("exposure", "loading"), "Market", key="account").select("account", "factor_name", sql_round("weight", 9).alias("weight"))


@query("n16_package_search", ", pk AS (SELECT ric, ticker, sector AS display_name, CASE WHEN cast(ric AS INTEGER) % 3 = 0 THEN 0 ELSE 1 END AS source_order FROM registry), sr AS (SELECT *, CASE WHEN ric = '12' THEN 0 WHEN starts_with(ric, '12') THEN 1 WHEN contains(ticker, '12') THEN 2 ELSE 2 END AS tier, CASE WHEN ric = '12' THEN 1 WHEN starts_with(ric, '12') THEN length(ric) WHEN contains(ticker, '12') THEN strpos(ticker, '12') - 1 ELSE strpos(ric, '12') - 1 END AS place FROM pk WHERE contains(ticker, '12') OR contains(ric, '12')) SELECT ric, ticker, display_name, source_order, tier, cast(place AS INTEGER) AS place FROM sr ORDER BY tier, place, upper(ticker), source_order, ric LIMIT 25")
def n16(spark, d):
    """The 25 best matches of 12."""
    rows = A.registry(spark, d).select("ric", "ticker", F.col("sector").alias("display_name"))
    return V.search(rows.where(F.col("ric").cast("int") % 3 == 0), rows, "12", 25)


@query("n18_watermarks", " SELECT 'fundamentals' AS \"table\", 'run-1' AS run, min(as_of_date) AS source_first, max(as_of_date) AS source_last, min(as_of_date) FILTER (WHERE as_of_date >= DATE '1994-01-01') AS target_first, max(as_of_date) FILTER (WHERE as_of_date >= DATE '1994-01-01') AS target_last, count(*) FILTER (WHERE as_of_date >= DATE '1994-01-01') AS target_rows FROM fundamentals UNION ALL SELECT 'prices', 'run-1', min(date), max(date), min(date), max(date), count(*) FROM prices")
def n18(spark, d):
    f = A.fundamentals(spark, d)
    return V.watermarks({"fundamentals": (f, f.where("as_of_date >= '1994-01-01'"), "as_of_date"), "prices": (A.prices(spark, d), A.prices(spark, d), "date")}, "run-1")


@query("n22_proxy_issues", ", sp AS (SELECT 'F' || ric AS factor_id, ticker, cast(ric AS INTEGER) AS n, ric FROM registry), an AS (SELECT DISTINCT ric FROM long_prices WHERE date BETWEEN DATE '1998-06-15' AND DATE '1998-06-19') SELECT factor_id, CASE WHEN n % 10 = 0 THEN 'missing' WHEN n % 10 = 1 THEN 'duplicate' WHEN an.ric IS NULL THEN 'no_terminal_price' END AS issue FROM sp LEFT JOIN an USING (ric) WHERE n % 10 IN (0, 1) OR an.ric IS NULL")
def n22(spark, d):
    n = F.col("ric").cast("int")
    r = A.registry(spark, d).select("ric", "ticker")
    proxies = r.where(n % 10 != 0).unionByName(r.where(n % 10 == 1))
    anchored = A.long_prices(spark, d).where("date between '1998-06-15' and '1998-06-19'")
    return V.proxy_issues(r.select(F.concat(F.lit("F"), "ric").alias("factor_id"), "ticker"), proxies, anchored)


@query("n23_projection_issues", ", x AS (SELECT ric AS ticker, cast(ric AS INTEGER) AS n FROM registry) SELECT ticker, 'universe' AS place, CASE WHEN n % 9 = 0 THEN 'missing' WHEN n % 4 = 0 THEN 'core_estimated' ELSE 'projected_only' END AS model_status, CASE WHEN n % 9 = 0 THEN 'missing' WHEN n % 6 = 0 THEN 'native' ELSE 'projected_returns' END AS exposure_origin FROM x WHERE n % 2 = 0 AND (n % 9 = 0 OR n % 4 = 0 OR n % 6 = 0) UNION ALL SELECT ticker, 'portfolio', 'core_estimated', 'projected' FROM x WHERE n % 2 = 0 AND n % 5 = 0")
def n23(spark, d):
    n = F.col("ric").cast("int")
    r = A.registry(spark, d)
    universe = r.where(n % 9 != 0).select(F.col("ric").alias("ticker"), F.when(n % 4 == 0, "core_estimated").otherwise("projected_only").alias("model_status"), F.when(n % 6 == 0, "native").otherwise("projected_returns").alias("exposure_origin"))
    book = r.where(n % 5 == 0).select(F.col("ric").alias("ticker"), F.lit("core_estimated").alias("model_status"), F.lit("projected").alias("exposure_origin"))
    return V.projection_issues(r.where(n % 2 == 0).select(F.col("ric").alias("ticker")), universe, book)


@query("h11_weekly_loadings", H.W + H.LOADINGS.replace(", n AS", ", nn AS").replace("FROM n", "FROM nn") + ", cw AS (SELECT account, ric, mv / sum(abs(mv)) OVER (PARTITION BY account) AS wt FROM w WHERE cast(ric AS INTEGER) % 4 <> 0 AND mv IS NOT NULL), pt AS (SELECT account, factor_name, wt * loading AS part FROM cw JOIN l USING (ric)) SELECT account, factor_name AS factor_id, round(sum(part), 6) AS loading, count(*) AS n FROM pt WHERE abs(part) > 1e-12 GROUP BY 1, 2")
def h11(spark, d):
    rows = H.weighted(spark, d).withColumn("covered", F.col("ric").cast("int") % 4 != 0)
    positions = V.weekly_positions(rows, H.loadings(spark, d).withColumnRenamed("factor_name", "factor_id"))
    return V.aggregate_loadings(positions).select("account", "factor_id", r6("loading").alias("loading"), "n")


@query("h09_universe_loadings", H.EX + ", sc AS (SELECT ric FROM parts WHERE cast(ric AS INTEGER) % 10 <> 9), un AS (SELECT ric, f, e, 'native' AS o FROM ex WHERE cast(ric AS INTEGER) % 3 <> 0 UNION ALL SELECT ric, f, e / 2, 'projected' FROM ex WHERE cast(ric AS INTEGER) % 6 = 0 AND f = 'Market'), ag AS (SELECT ric, count(*) AS n, round(sum(abs(round(e * fs.v, 6))), 6) AS risk_loading, max(o) AS exposure_origin FROM un JOIN fs USING (f) GROUP BY 1) SELECT sc.ric, cast(coalesce(n, 0) AS BIGINT) AS n, risk_loading, exposure_origin, CASE exposure_origin WHEN 'native' THEN 'core_estimated' WHEN 'projected' THEN 'projected_only' ELSE 'ineligible' END AS model_status FROM sc LEFT JOIN ag USING (ric)")
def h09(spark, d):
    n = F.col("ric").cast("int")
    rows = H.exposures(spark, d)
    projected = rows.where((n % 2 == 0) & (F.col("factor_name") == "Market")).withColumn("exposure", F.col("exposure") / 2)
    out = V.universe_loadings(rows.where(n % 3 != 0), H.covariance(spark, d), projected, A.parts(spark, d).where(n % 10 != 9))
    return out.select("ric", F.coalesce(F.size("factors"), F.lit(0)).cast("long").alias("n"), "risk_loading", "exposure_origin", "model_status")


@query("j10_compatibility_view", ", x AS (SELECT ric, ticker, cast(ric AS INTEGER) AS n FROM registry), ob AS (SELECT ric, cast(arg_max(status, (as_of_date, seq)) = 'F' AS INTEGER) AS ready, cast(arg_max(market_cap, (as_of_date, seq)) > 100000 AS INTEGER) AS equity FROM fundamentals GROUP BY 1) SELECT x.ric, upper(ticker) AS ticker, coalesce(CASE WHEN n % 3 = 0 THEN n % 2 END, ready, 0) AS classification_ok, CASE WHEN coalesce(CASE WHEN n % 3 = 0 THEN 1 END, equity, 0) = 1 THEN 1 ELSE 0 END AS is_equity_eligible, CASE WHEN n % 4 = 0 AND n % 8 <> 0 THEN 'projection_only' ELSE 'native_equity' END AS coverage_role FROM x LEFT JOIN ob USING (ric) WHERE n % 5 <> 0")
def j10(spark, d):
    n = F.col("ric").cast("int")
    r = A.registry(spark, d)
    observed = A.fundamentals(spark, d).select("ric", "as_of_date", F.col("seq").alias("updated"), (F.col("status") == "F").cast("int").alias("ready"), (F.col("market_cap") > 100_000).cast("int").alias("equity"))
    policy = r.where(n % 4 == 0).select("ric", F.lit(1).alias("projection"), (n % 8 == 0).cast("int").alias("pit_fundamentals"), F.lit(0).alias("pit_classification"))
    taxonomy = r.where(n % 3 == 0).select("ric", (n % 2).alias("ready"), F.lit(1).alias("equity"))
    return V.compatibility_view(r.select("ric", "ticker", F.when(n % 5 == 0, "disabled").alias("tracking")), policy, taxonomy, observed)


@query("n14_account_risk_page", H.CAT + ", x AS (SELECT account, category, variance AS p FROM cv UNION ALL SELECT account, 'idio', s FROM sp) SELECT account, category, round(p / sum(p) OVER (PARTITION BY account) * 100, 2) AS share FROM x WHERE cast(account AS INTEGER) % 2 = 1")
def n14(spark, d):
    """Risk shares of the accounts asked for; positions of others aren't weighed."""
    asked = A.holdings(spark, d).where(F.col("account").cast("int") % 2 == 1)
    rows = P.positions(asked, A.parts(spark, d))
    specific = P.specific_variance(rows, A.parts(spark, d).select("ric", (F.col("price") / 1e5).alias("specific_var")))
    cells = P.quadratic_cells(P.book_exposures(rows, H.exposures(spark, d)), H.covariance(spark, d))
    return P.risk_shares(P.category_variance(cells, H.category), specific)
