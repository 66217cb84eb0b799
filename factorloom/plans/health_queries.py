"""Queries of the model's health, a section each, from the daily job's tables, a book of the registry and source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from ..operators import health as E
from ..operators import jobs as J
from ..operators import portfolio as P
from ..operators import relational as R
from ..operators import riskmodel as M
from ..operators import timeseries as T
from ..sources import adapters as A
from ..sources import sinks as K
from . import kernel_queries as G
from . import service_queries as S
from .catalog import query

STYLES = S.DAILY["styles"]


def shown(df):
    """Values to 6 places; -0 is 0."""
    return df.withColumns({c: sql_round(c, 6) + 0.0 for c in ("x", "value")})


def rows_of(section, part, table, *, name="NULL", other="NULL", date="NULL", place="NULL", x="NULL", value):
    """The SQL of one part of a section."""
    return f"SELECT {section} AS section, '{part}' AS part, CAST({name} AS VARCHAR) AS name, CAST({other} AS VARCHAR) AS other, CAST({date} AS DATE) AS date, CAST({place} AS INTEGER) AS place, round(CAST({x} AS DOUBLE), 6) + 0e0 AS x, round(CAST({value} AS DOUBLE), 6) + 0e0 AS value FROM {table}"


def unpivoted(section, part, table, key, measures, as_name=True):
    """key: the date, or the name with measures as other."""
    each = (lambda m: {"name": f"'{m}'", "date": "date"}) if as_name else (lambda m: {"name": key, "other": f"'{m}'"})
    return [rows_of(section, part, table, value=m, **each(m)) for m in measures]


def histogram_sql(name, table, by, value, bins, bound=None):
    """Tables that end with <name> (by, place, x, n)."""
    low, high = (f"quantile_cont({value}, 0.01)", f"quantile_cont({value}, 0.99)") if bound is None else (f"-{bound:e}", f"{bound:e}")
    edges = f", {name}_a AS (SELECT {by}, {low} AS lo, {high} AS hi FROM {table} GROUP BY 1), {name}_e AS (SELECT {by}, CASE WHEN hi > lo THEN lo ELSE lo - 1 END AS lo, CASE WHEN hi > lo THEN hi ELSE hi + 1 END AS hi FROM {name}_a)"
    counts = f", {name}_c AS (SELECT {by}, cast(least(floor(({value} - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS place, count(*) AS n FROM {table} JOIN {name}_e USING ({by}) WHERE {value} BETWEEN lo AND hi GROUP BY 1, 2)"
    every = f"SELECT {by}, cast(g.i AS INTEGER) AS place, lo, hi FROM {name}_e CROSS JOIN range({bins}) g(i)"
    return edges + counts + f", {name} AS (SELECT {by}, place, lo + (place + 5e-1) * (hi - lo) / {bins} AS x, coalesce(n, 0) AS n FROM ({every}) LEFT JOIN {name}_c USING ({by}, place))"


BOOKS = "bp AS (SELECT ric, balance AS mv, round(balance / sum(abs(balance)) OVER (), 6) AS weight FROM registry), bk AS (SELECT 'current' AS account, ric, weight FROM bp UNION ALL SELECT 'long_only', ric, 1e0 / count(*) OVER () FROM bp WHERE mv > 0 UNION ALL SELECT 'dollar_neutral', ric, sign(mv) * 1e0 / count(*) OVER (PARTITION BY mv > 0) FROM bp WHERE mv <> 0 UNION ALL SELECT 'index', '1', 1e0)"
CHAIN = S.CHAIN.replace("bk AS (SELECT scope AS account, ric, round(balance / sum(abs(balance)) OVER (PARTITION BY scope), 6) AS weight FROM registry)", BOOKS)
HF = ", hf AS (SELECT al.date, factor_name, b AS factor_return, CASE WHEN se > 0 THEN b / se ELSE 0 END AS t_stat, r2 AS r_squared, 't_stat' AS one FROM al JOIN fx USING (date)), hw AS (SELECT max(date) AS date FROM al GROUP BY date_trunc('week', date + 2)), hs AS (SELECT hf.* FROM hf JOIN hw USING (date))"
GRID = ", pv AS (SELECT d.date, f.factor_name, coalesce(factor_return, 0) AS ret FROM (SELECT DISTINCT date FROM hf) d CROSS JOIN (SELECT DISTINCT factor_name FROM hf) f LEFT JOIN hf USING (date, factor_name)), pw AS (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(ret) OVER w * sqrt(252e0) END AS vol, product(1 + ret) OVER (PARTITION BY factor_name ORDER BY date) - 1 AS total FROM pv WINDOW w AS (PARTITION BY factor_name ORDER BY date ROWS 59 PRECEDING))"


def ledger(spark, d):
    """(factor returns, residuals) of the daily job."""
    root = S.daily_ledger(spark, d)
    return J.table(spark, root, "factor_returns"), J.table(spark, root, "residuals")


def book(spark, d):
    """The registry's balances as one book, beside three it is compared with."""
    r = A.registry(spark, d)
    rows = P.positions(r.select(F.lit("book").alias("account"), "ric", F.col("balance").alias("quantity")), r.select("ric", F.lit(1.0).alias("price")))
    index = r.limit(1).select(F.lit("1").alias("ric"))
    return E.model_books(rows.select("ric", "weight", "market_value"), index)


def risk_inputs(spark, d, returns, residuals):
    """(books, exposures of the last date, covariance, specific variances)."""
    cov = K.stored(M.factor_covariance(returns.select("date", "factor_name", "factor_return")), "covariance")
    specific = K.stored(M.specific_risk(residuals.withColumnRenamed("industry", "sector")).select("ric", "specific_var"), "specific")
    last = residuals.join(F.broadcast(residuals.agg(F.max("date").alias("date"))), "date", "left_semi")
    ones = last.select("ric", F.lit("Market").alias("factor_name"), F.lit(1.0).alias("exposure"))
    return K.stored(book(spark, d), "books"), ones.unionByName(E.exposures_of(last, STYLES).drop("date")), cov, specific


def regression_sql():
    mean = lambda c, n, least, out: f"CASE WHEN count({c}) OVER w{n} >= {least} THEN avg({c}) OVER w{n} ELSE {c} END AS {out}"
    windows = " WINDOW w12 AS (ORDER BY date ROWS 11 PRECEDING), w52 AS (ORDER BY date ROWS 51 PRECEDING)"
    block = ["r2_full", "r2_structural", "r2_style_incremental"]
    rolls = [c.replace("r2", "roll60", 1) for c in block]
    sql = CHAIN + HF + f", rr AS (SELECT date, avg(r_squared) AS r2 FROM hs GROUP BY 1), rz AS (SELECT date, r2, {mean('r2', 12, 4, 'roll60')}, {mean('r2', 52, 8, 'roll252')} FROM rr{windows})"
    sql += ", bl AS (SELECT er.date, any_value(fx.r2) AS r2_full, 1 - sum(sqrt(cap) * power(e + s1 * g1 + s2 * g2, 2)) * greatest(1e-10, 1 - any_value(fx.r2)) / sum(sqrt(cap) * e * e) AS r2_structural FROM er JOIN hw USING (date) JOIN (SELECT date, any_value(b1) AS g1, any_value(b2) AS g2 FROM lv GROUP BY 1) g USING (date) JOIN fx USING (date) GROUP BY 1 HAVING count(*) >= 20)"
    sql += f", bm AS (SELECT *, r2_full - r2_structural AS r2_style_incremental FROM bl), bz AS (SELECT *, {', '.join(mean(c, 12, 4, o) for c, o in zip(block, rolls, strict=True))} FROM bm{windows})"
    sql += histogram_sql("th", "hf", "one", "t_stat", E.T_BINS, E.T_BOUND)
    sides = "coalesce(avg(abs(t_stat)) FILTER (WHERE factor_name IN ('Size', 'Value')), 0) AS style, coalesce(avg(abs(t_stat)) FILTER (WHERE factor_name NOT IN ('Size', 'Value')), 0) AS other"
    sql += f", bd AS (SELECT date, {sides} FROM hs GROUP BY 1), bt AS (SELECT {sides} FROM hs), hr AS (SELECT factor_name, round(avg(CASE WHEN abs(t_stat) > 2 THEN 1e0 ELSE 0 END) * 100, 2) AS hit FROM hf GROUP BY 1)"
    sql += ", vs AS (SELECT category, variance AS p FROM cv WHERE account = 'current' UNION ALL SELECT 'idio', s FROM sp WHERE account = 'current'), vt AS (SELECT category, CASE WHEN sum(p) OVER () > 1e-12 THEN round(p / sum(p) OVER () * 100, 2) WHEN category = 'idio' THEN 100 ELSE 0 END AS share FROM vs), vf AS (SELECT category, CASE WHEN sum(variance) OVER () > 0 THEN variance / sum(variance) OVER () * 100 ELSE 0 END AS v FROM cv WHERE account = 'current')"
    parts = unpivoted(1, "r2_series", "rz", "date", ["r2", "roll60", "roll252"]) + unpivoted(1, "block_r2_series", "bz", "date", block + rolls) + unpivoted(1, "breadth_series", "bd", "date", ["style", "other"])
    parts += [rows_of(1, "breadth", "bt", name=f"'{m}'", value=m) for m in ("style", "other")]
    parts += [rows_of(1, "t_stat_histogram", "th", place="place", x="x", value="n"), rows_of(1, "hit_rate", "hr", name="factor_name", value="hit"), rows_of(1, "variance_split", "vt", name="category", value="share"), rows_of(1, "factor_variance_split", "vf", name="category", value="v")]
    return sql + " " + " UNION ALL ".join(parts)


@query("n12_health_regression", regression_sql())
def n12(spark, d):
    returns, residuals = ledger(spark, d)
    books, exposures, cov, specific = risk_inputs(spark, d, returns, residuals)
    mine = books.where("account = 'current'")
    by_category = P.category_variance(P.quadratic_cells(P.book_exposures(mine, exposures), cov), S.chain_category)
    return shown(E.regression_section(returns, residuals, STYLES, by_category, P.specific_variance(mine, specific)))


def exposure_sql():
    sql = G.G05 + ", hl AS (SELECT * FROM er WHERE date = (SELECT max(date) FROM er)), hk AS (SELECT DISTINCT industry AS f FROM hl UNION ALL SELECT 'Size' FROM (SELECT 1 FROM hl LIMIT 1) UNION ALL SELECT 'Value' FROM (SELECT 1 FROM hl LIMIT 1)), hx AS (SELECT ric, f, CASE f WHEN 'Size' THEN s1 WHEN 'Value' THEN s2 WHEN industry THEN 1e0 ELSE 0e0 END AS x FROM hl CROSS JOIN hk)"
    sql += ", fs AS (SELECT f, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99, max(abs(x)) AS max_abs FROM hx GROUP BY 1)"
    sql += histogram_sql("fh", "(SELECT ric, f, x AS v FROM hx)", "f", "v", E.EXPOSURE_BINS)
    sql += ", fc AS (SELECT a.f, b.f AS g, CASE WHEN stddev_pop(a.x) > 1e-9 AND stddev_pop(b.x) > 1e-9 THEN corr(a.x, b.x) ELSE 0 END AS c FROM hx a JOIN hx b USING (ric) GROUP BY 1, 2)"
    sql += ", wd AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT max(date) AS date FROM er GROUP BY date_trunc('week', date + 2))), we AS (SELECT er.date, ric, industry, s1, s2 FROM er JOIN wd USING (date)), cu AS (SELECT wd.date, we.* EXCLUDE (date) FROM we JOIN wd ON wd.date = we.date WHERE before IS NOT NULL), pr AS (SELECT wd.date, we.* EXCLUDE (date) FROM we JOIN wd ON wd.before = we.date)"
    known = lambda t: f"CASE WHEN {t}.industry IN (SELECT f FROM hk) THEN 1 ELSE 0 END"
    sql += f", mv AS (SELECT coalesce(cu.date, pr.date) AS date, abs(coalesce(cu.s1, 0) - coalesce(pr.s1, 0)) + abs(coalesce(cu.s2, 0) - coalesce(pr.s2, 0)) + CASE WHEN cu.industry = pr.industry THEN 0 ELSE {known('cu')} + {known('pr')} END AS c FROM cu FULL JOIN pr ON cu.date = pr.date AND cu.ric = pr.ric)"
    sql += ", tr AS (SELECT mv.date, sum(c) / (count(*) * (SELECT count(*) FROM hk)) AS raw_turnover, cast(greatest(1, date_diff('day', min(before), mv.date)) AS DOUBLE) AS interval_days FROM mv JOIN wd ON wd.date = mv.date GROUP BY 1), tu AS (SELECT *, raw_turnover / interval_days AS turnover FROM tr), tz AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(turnover) OVER w ELSE turnover END AS roll60 FROM tu WINDOW w AS (ORDER BY date ROWS 59 PRECEDING))"
    parts = unpivoted(2, "factor_stats", "fs", "f", ["mean", "std", "p1", "p99", "max_abs"], False) + unpivoted(2, "turnover_series", "tz", "date", ["turnover", "roll60", "raw_turnover", "interval_days"])
    parts += [rows_of(2, "factor_histogram", "fh", name="f", place="place", x="x", value="n"), rows_of(2, "exposure_correlation", "fc", name="f", other="g", value="c")]
    return sql + " " + " UNION ALL ".join(parts)


@query("n12b_health_exposures", exposure_sql())
def n12b(spark, d):
    return shown(E.exposure_section(ledger(spark, d)[1], STYLES))


def return_sql():
    sql = G.G05 + HF + GRID + histogram_sql("rh", "pv", "factor_name", "ret", E.RETURN_BINS) + ", rc AS (SELECT a.factor_name AS f, b.factor_name AS g, CASE WHEN stddev_pop(a.ret) > 0 AND stddev_pop(b.ret) > 0 THEN corr(a.ret, b.ret) ELSE 0 END AS c FROM pv a JOIN pv b USING (date) GROUP BY 1, 2)"
    parts = [rows_of(3, "cumulative_return", "pw", name="factor_name", date="date", value="total"), rows_of(3, "rolling_vol", "pw", name="factor_name", date="date", value="coalesce(vol, 0)"), rows_of(3, "return_correlation", "rc", name="f", other="g", value="c"), rows_of(3, "return_histogram", "rh", name="factor_name", place="place", x="x", value="n")]
    return sql + " " + " UNION ALL ".join(parts)


@query("n12c_health_returns", return_sql())
def n12c(spark, d):
    return shown(E.return_section(K.stored(E.filled_returns(ledger(spark, d)[0]), "filled")))


def risk_sql():
    sql = CHAIN + HF + GRID + ", bv AS (SELECT account, sum(p) AS v FROM cells GROUP BY 1), hb AS (SELECT * FROM y WHERE ric IN (SELECT ric FROM bk)), hd AS (SELECT DISTINCT date FROM hb ORDER BY date DESC LIMIT 60), dr AS (SELECT account, date, sum(weight * coalesce(ret, 0)) AS ret FROM bk JOIN hb USING (ric) JOIN hd USING (date) GROUP BY 1, 2), ac AS (SELECT DISTINCT account FROM bk), rv AS (SELECT account, CASE WHEN count(*) >= 3 THEN stddev_samp(coalesce(ret, 0)) * sqrt(252e0) ELSE 0 END AS realized FROM ac CROSS JOIN hd LEFT JOIN dr USING (account, date) GROUP BY 1)"
    sql += ", fw AS (SELECT account, sqrt(greatest(coalesce(v, 0) + coalesce(s, 0), 0)) AS forecast, coalesce(realized, 0) AS realized FROM ac LEFT JOIN bv USING (account) LEFT JOIN sp USING (account) LEFT JOIN rv USING (account)), av AS (SELECT date, coalesce(avg(vol), 0) AS v FROM pw GROUP BY 1), tc AS (SELECT sum(c) AS t FROM cov WHERE f = g)"
    return sql + " " + " UNION ALL ".join([*unpivoted(4, "forecast_and_realized", "fw", "account", ["forecast", "realized"], False), rows_of(4, "average_factor_vol", "av", date="date", value="v"), rows_of(4, "eigenvalues", "tc", name="'sum'", value="t")])


@query("n12d_health_risk", risk_sql())
def n12d(spark, d):
    """Eigenvalues stand here as their sum."""
    returns, residuals = ledger(spark, d)
    books, exposures, cov, specific = risk_inputs(spark, d, returns, residuals)
    rows = K.stored(E.filled_returns(returns), "filled")
    out = K.stored(E.risk_section(cov, books, exposures, specific, T.panel_returns(A.prices(spark, d)).select("ric", "date", "ret"), rows), "risk")
    total = out.where("part = 'eigenvalues'").agg(F.sum("value").alias("v"))
    return shown(out.where("part <> 'eigenvalues'").unionByName(E.part(total, 4, "eigenvalues", name=F.lit("sum"), value=F.col("v"))))


def coverage_sql():
    sql = ", lf AS (SELECT min(date) AS lo, max(date) AS hi, ric FROM long_prices GROUP BY ric), fo AS (SELECT ric, as_of_date, arg_max(market_cap, seq) AS market_cap, arg_max(status, seq) AS status, arg_max(priority, seq) AS priority FROM fundamentals JOIN registry USING (ric) GROUP BY 1, 2), fa AS (SELECT fo.* FROM fo JOIN lf USING (ric) WHERE as_of_date BETWEEN lo AND hi)"
    sql += ", cc AS (SELECT 'classification' AS part, 'priority' AS field, ric, as_of_date, CASE WHEN priority <> '5-LOW' THEN 1 ELSE 0 END AS ok FROM fa UNION ALL SELECT 'classification', 'status', ric, as_of_date, CASE WHEN status <> '' THEN 1 ELSE 0 END FROM fa UNION ALL SELECT 'fundamentals', 'market_cap', ric, as_of_date, CASE WHEN status <> 'P' THEN 1 ELSE 0 END FROM fa UNION ALL SELECT 'fundamentals', 'large', ric, as_of_date, CASE WHEN market_cap > 250000 THEN 1 ELSE 0 END FROM fa)"
    sql += ", ck2 AS (SELECT part, field, ric, count(*) AS n, sum(ok) AS ok FROM cc GROUP BY 1, 2, 3 HAVING part = 'classification' OR sum(ok) > 0), cp AS (SELECT *, ok / n * 100e0 AS pct FROM ck2), kk AS (SELECT part, field, sum(n) AS total_rows, sum(ok) AS non_null_rows, avg(pct) AS key_pct, quantile_cont(pct, 0.1) AS key_pct_p10, count(*) FILTER (WHERE pct < 80) AS keys_below, count(*) AS keys FROM cp GROUP BY 1, 2)"
    sql += ", cd AS (SELECT part, field, as_of_date, sum(cc.ok) / count(*) * 100e0 AS pct FROM cc JOIN ck2 USING (part, field, ric) GROUP BY 1, 2, 3), dd AS (SELECT part, field, avg(pct) AS date_pct, min(pct) AS worst_date_pct, arg_min(as_of_date, (pct, as_of_date)) AS worst_date, count(*) FILTER (WHERE pct < 80) AS dates_below FROM cd GROUP BY 1, 2)"
    sql += ", cz AS (SELECT *, non_null_rows / total_rows * 100e0 AS row_pct, 4e-1 * (non_null_rows / total_rows * 100e0) + 4e-1 * key_pct + 2e-1 * key_pct_p10 AS score FROM kk JOIN dd USING (part, field)), ct AS (SELECT count(*) AS \"rows\", count(DISTINCT as_of_date) AS dates, count(DISTINCT ric) AS keys FROM fa)"
    parts = []
    for t in ("classification", "fundamentals"):
        parts += [rows_of(5, t, f"cz WHERE part = '{t}'", name="field", other=f"'{m}'", date="worst_date" if m == "worst_date_pct" else "NULL", value=m) for m in ("total_rows", "non_null_rows", "key_pct", "key_pct_p10", "keys_below", "keys", "date_pct", "dates_below", "row_pct", "worst_date_pct", "score")]
        parts += [rows_of(5, t, "ct", other=f"'{m}'", value=f'"{m}"') for m in ("rows", "dates", "keys")]
        parts.append(rows_of(5, t, f"(SELECT count(*) FILTER (WHERE score < 80) AS v FROM cz WHERE part = '{t}')", other="'low_fields'", value="v"))
    return sql + " " + " UNION ALL ".join(parts)


@query("n12e_health_coverage", coverage_sql())
def n12e(spark, d):
    """Fundamentals count against keys that report a field at all, classifications against every key."""
    known = A.fundamentals(spark, d).join(A.registry(spark, d).select("ric"), "ric")
    rows = K.stored(R.latest_wide(known, ["ric", "as_of_date"], ["seq"], ["market_cap", "status", "priority"]), "known")
    tables = {
        "fundamentals": (rows, {"market_cap": F.col("status") != "P", "large": F.col("market_cap") > 250_000}, True),
        "classification": (rows, {"priority": F.col("priority") != "5-LOW", "status": F.col("status") != ""}, False),
    }
    return shown(E.coverage_section(tables, A.long_prices(spark, d), date="as_of_date"))
