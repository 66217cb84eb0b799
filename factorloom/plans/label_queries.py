"""Queries for labels and filters; inputs are made from registry and holdings columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numbers import sql_round
from ..sources import adapters as A
from .catalog import query

#: Stand-ins for a security's identifiers, the same in both languages.
IDS = ", ids AS (SELECT cast(ric AS INTEGER) AS n, ric || CASE cast(ric AS INTEGER) % 7 WHEN 0 THEN '.N' WHEN 1 THEN '.OQ' WHEN 2 THEN '.O' WHEN 3 THEN '^A' WHEN 4 THEN '.L' WHEN 5 THEN ' ' ELSE '.K' END AS code, CASE cast(ric AS INTEGER) % 11 WHEN 0 THEN ticker || '*' WHEN 1 THEN ' nan ' ELSE lower(ticker) END AS tick, CASE cast(ric AS INTEGER) % 5 WHEN 0 THEN 'Nasdaq OMX PSX' WHEN 1 THEN 'Consolidated Issue' WHEN 2 THEN 'Pink Sheets' WHEN 3 THEN 'NYSE' END AS exchange, sector, country, scope, balance FROM registry) "


def ids(spark, d):
    r, n = A.registry(spark, d), F.col("ric").cast("int")
    at = lambda k, values, other=None: L.ladder(*[(n % k == i, F.lit(v)) for i, v in enumerate(values)], otherwise=other)
    tick = F.when(n % 11 == 0, F.concat("ticker", F.lit("*"))).when(n % 11 == 1, " nan ").otherwise(F.lower("ticker"))
    return r.select(n.alias("n"), F.concat("ric", at(7, [".N", ".OQ", ".O", "^A", ".L", " "], ".K")).alias("code"), tick.alias("tick"), at(5, ["Nasdaq OMX PSX", "Consolidated Issue", "Pink Sheets", "NYSE"]).alias("exchange"), "sector", "country", "scope", "balance")


@query("b01_identifiers", IDS + "SELECT n, upper(trim(code)) AS ric, CASE WHEN lower(trim(tick)) IN ('', 'nan', 'none') THEN NULL ELSE upper(trim(tick)) END AS ticker, split_part(upper(trim(code)), '.', 1) AS prefix FROM ids")
def b01(spark, d):
    return ids(spark, d).select("n", L.identifier(F.col("code")).alias("ric"), L.identifier(F.col("tick")).alias("ticker"), L.ticker_of(F.col("code")).alias("prefix"))


@query("b02_clean_text", IDS + "SELECT n, CASE WHEN trim(tick) IN ('nan', 'None', 'Unmapped') THEN '' ELSE trim(tick) END AS t FROM ids")
def b02(spark, d):
    return ids(spark, d).select("n", L.clean_text(F.col("tick")).alias("t"))


@query("b03_source_exclusion", IDS + "SELECT n, CASE WHEN contains(code, '^') THEN 'lineage_ric' WHEN contains(tick, '*') THEN 'alias_ticker' WHEN contains(upper(exchange), 'CONSOLIDATED') THEN 'consolidated_exchange' WHEN contains(upper(exchange), 'PINK SHEETS') THEN 'pink_sheets' WHEN contains(upper(exchange), ' PSX') THEN 'secondary_psx' END AS reason FROM ids")
def b03(spark, d):
    return ids(spark, d).select("n", L.source_exclusion(F.col("code"), F.col("tick"), F.col("exchange")).alias("reason"))


@query("b04_structural_eligibility", IDS + "SELECT n, concat_ws('|', CASE WHEN NOT (n % 3 <> 0) THEN 'missing_style' END, CASE WHEN balance <= 0 THEN 'missing_market_cap' END, CASE WHEN exchange IS NULL THEN 'missing_trbc_economic_sector_short' END, CASE WHEN trim(tick) = 'nan' THEN 'missing_trbc_industry' END) AS reasons FROM ids")
def b04(spark, d):
    return ids(spark, d).select("n", L.structural_reasons(F.col("n") % 3 != 0, F.col("balance"), F.col("exchange"), F.col("tick"), F.col("country")).alias("reasons"))


@query("b05_non_equity", IDS + "SELECT n, CASE WHEN n % 4 = 0 THEN 'Exchange Traded Fund' ELSE sector END IN ('Exchange Traded Fund', 'Digital Asset') AS non_equity FROM ids")
def b05(spark, d):
    return ids(spark, d).select("n", F.when(F.col("n") % 4 == 0, "Exchange Traded Fund").otherwise(F.col("sector")).isin(*L.NON_EQUITY_SECTORS).alias("non_equity"))


@query("b06_estimation_universe", ", q AS (SELECT ric, count(*) AS obs, arg_max(close, date) AS price FROM prices GROUP BY 1), t AS (SELECT ric, avg(close * volume) AS adv FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY ric ORDER BY date DESC) <= 20) GROUP BY 1), f AS (SELECT ric, arg_max(market_cap, seq) AS cap FROM fundamentals WHERE as_of_date >= DATE '1998-01-01' GROUP BY 1) SELECT r.ric, CASE WHEN r.scope = 'ASIA' THEN 'not_native_core_candidate' WHEN r.sector = 'BUILDING' THEN 'not_single_name_equity' WHEN q.obs IS NULL OR q.obs < 24 THEN 'missing_price_history' WHEN f.cap IS NULL THEN 'missing_fundamentals' WHEN q.price < 20 THEN 'price_floor' WHEN f.cap < 100000 THEN 'microcap' WHEN t.adv < 100 THEN 'illiquid' ELSE '' END AS reason FROM registry r LEFT JOIN q USING (ric) LEFT JOIN t USING (ric) LEFT JOIN f USING (ric)")
def b06(spark, d):
    from ..operators.relational import latest

    p = A.prices(spark, d)
    q = p.groupBy("ric").agg(F.count("*").alias("obs"), F.max_by("close", "date").alias("price"))
    t = latest(p, ["ric"], [F.desc("date")], 20).groupBy("ric").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
    f = A.fundamentals(spark, d).where("as_of_date >= date'1998-01-01'").groupBy("ric").agg(F.max_by("market_cap", "seq").alias("cap"))
    rows = A.registry(spark, d).join(q, "ric", "left").join(t, "ric", "left").join(f, "ric", "left")
    reason = L.drop_reason(F.col("scope") != "ASIA", F.col("sector") != "BUILDING", F.lit(True), F.col("obs"), F.col("cap"), F.lit(True), F.col("price"), F.col("adv"), least_observations=24, least_price=20.0, least_cap=100_000.0, least_adv=100.0)
    return rows.select("ric", reason.alias("reason"))


@query("b07_country_of_suffix", IDS + ", s AS (SELECT n, CASE WHEN contains(code, '.') THEN split_part(trim(code), '.', 2) ELSE '' END AS s FROM ids) SELECT n, CASE WHEN s IN ('N','O','A','K','P','PK','Q') THEN 'US' ELSE '' END AS estimation, CASE WHEN s IN ('N','OQ','O','A','K','P','PK','Q') THEN 'US' ELSE '' END AS membership FROM s")
def b07(spark, d):
    return ids(spark, d).select("n", L.country_of_suffix(F.col("code"), L.US_SUFFIXES_ESTIMATION).alias("estimation"), L.country_of_suffix(F.col("code"), L.US_SUFFIXES_MEMBERSHIP).alias("membership"))


@query("b08_suffix_rank", IDS + "SELECT n, CASE WHEN code LIKE '%.N' THEN 0 WHEN code LIKE '%.OQ' THEN 1 WHEN code LIKE '%.O' THEN 2 WHEN code LIKE '%.K' THEN 3 WHEN code LIKE '%.P' THEN 4 ELSE 99 END AS rank FROM ids")
def b08(spark, d):
    return ids(spark, d).select("n", L.suffix_rank(F.col("code")).alias("rank"))


@query("b09_model_status", IDS + "SELECT CASE WHEN n % 3 = 0 THEN 'core_estimated' WHEN n % 3 = 1 THEN 'projected_only' ELSE 'ineligible' END AS status, count(*) AS c FROM ids GROUP BY 1")
def b09(spark, d):
    return ids(spark, d).groupBy(L.model_status(F.col("n") % 3 == 0, F.col("n") % 3 == 1).alias("status")).agg(F.count("*").alias("c"))


@query("b10_factor_ids", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'style_' || slug WHEN p_partkey % 3 = 1 THEN 'market' ELSE 'industry_' || slug END AS factor_id FROM (SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part)")
def b10(spark, d):
    family = F.get(F.array(F.lit("style"), F.lit("market"), F.lit("industry")), (F.col("p_partkey") % 3).cast("int"))
    return A.read(spark, d, "part").select("p_partkey", L.factor_id(F.col("p_name"), family, F.col("p_name")).alias("factor_id"))


@query("b11_policy_flags", IDS + ", k AS (SELECT n, CASE WHEN n % 9 = 0 THEN 'projection_only' END AS role, CASE n % 4 WHEN 0 THEN 'fund_vehicle' WHEN 1 THEN 'single_name_equity' WHEN 2 THEN 'other' END AS kind, CASE n % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ex_us' END AS home, CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS single FROM ids), b AS (SELECT n, CASE WHEN role IS NOT NULL THEN '10000101' WHEN coalesce(kind, 'other') = 'other' AND home IS NULL AND single = 0 THEN '11110011' WHEN kind = 'fund_vehicle' THEN '10000101' WHEN single = 1 AND home IS NULL THEN '11110011' WHEN single = 1 AND home = 'us' THEN '11110011' WHEN single = 1 THEN '11101001' ELSE '10000001' END AS bits FROM k) SELECT n, bits FROM b")
def b11(spark, d):
    n = F.col("n")
    role = F.when(n % 9 == 0, "projection_only")
    kind = L.ladder((n % 4 == 0, "fund_vehicle"), (n % 4 == 1, "single_name_equity"), (n % 4 == 2, "other"))
    home = L.ladder((n % 3 == 0, "us"), (n % 3 == 1, "ex_us"))
    flags = ids(spark, d).select("n", L.policy_flags(role, kind, home, (n % 4 == 1).cast("int")).alias("f"))
    return flags.select("n", F.concat(*[F.col(f"f.{c}").cast("string") for c in L.POLICY_FLAGS]).alias("bits"))


@query("b12_taxonomy", IDS + "SELECT n, CASE WHEN n % 10 = 0 OR n % 4 = 0 THEN 'fund_vehicle' ELSE 'single_name_equity' END AS instrument_kind, CASE WHEN n % 10 = 0 THEN 'projection_only_vehicle' WHEN n % 4 = 0 THEN 'classified_non_equity' ELSE 'equity_security' END AS vehicle_structure, CASE WHEN scope = 'AMERICA' THEN 'us' ELSE 'ex_us' END AS home, CASE WHEN n % 10 = 0 OR n % 4 = 0 THEN 0 ELSE 1 END AS single FROM ids")
def b12(spark, d):
    n = F.col("n")
    t = L.taxonomy(F.when(n % 10 == 0, "projection_only"), F.when(n % 4 == 0, "Digital Asset").otherwise(F.col("sector")), F.when(F.col("scope") == "AMERICA", "US").otherwise(F.col("country")), F.lit(0), F.lit(0))
    return ids(spark, d).select("n", t.alias("t")).select("n", "t.instrument_kind", "t.vehicle_structure", F.col("t.scope").alias("home"), F.col("t.is_single_name_equity").alias("single"))


@query("b13_structural_fallback", IDS + "SELECT n, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 6 = 0 THEN 'equity_security' ELSE 'other' END ELSE 'equity_security' END AS vehicle FROM ids")
def b13(spark, d):
    """Without a classification the observed flags decide."""
    n = F.col("n")
    nothing = n % 2 == 0
    t = L.taxonomy(F.lit(None).cast("string"), F.when(~nothing, F.col("sector")), F.when(~nothing, F.col("country")), (n % 6 == 0).cast("int"), (n % 3 == 0).cast("int"))
    return ids(spark, d).select("n", t["vehicle_structure"].alias("vehicle"))


@query("b14_policy_not_future", "SELECT ric, max(seq) FILTER (WHERE as_of_date <= DATE '1997-06-30') AS effective FROM fundamentals GROUP BY 1")
def b14(spark, d):
    return A.fundamentals(spark, d).groupBy("ric").agg(F.max(F.when(F.col("as_of_date") <= F.lit("1997-06-30").cast("date"), F.col("seq"))).alias("effective"))


ROLES = IDS + ", m AS (SELECT n, CASE n % 3 WHEN 0 THEN 'core_estimated' WHEN 1 THEN 'projected_only' ELSE 'ineligible' END AS status, CASE WHEN n % 4 = 0 THEN 'projected' ELSE 'native' END AS origin, CASE WHEN n % 5 = 0 THEN 'returns_projection' ELSE '' END AS reason, n % 7 <> 0 AS served, CASE WHEN n % 14 = 0 THEN 'projection_unavailable' ELSE 'served' END AS output, n % 6 = 0 AS home FROM ids), r AS (SELECT *, CASE WHEN status = 'core_estimated' THEN status WHEN status = 'projected_only' AND (origin = 'projected' OR reason <> '') THEN 'projected_returns' WHEN status = 'projected_only' THEN 'projected_fundamental' ELSE 'ineligible' END AS role FROM m)"


@query("b15_roles", ROLES + " SELECT n, role, CASE WHEN n % 11 = 0 THEN 'returns_projection_candidate' WHEN n % 13 = 0 THEN 'fundamental_projection_candidate' WHEN n % 2 = 0 AND NOT home THEN 'fundamental_projection_candidate' WHEN role = 'core_estimated' OR home THEN 'native_core_candidate' ELSE 'untracked' END AS path, CASE WHEN NOT served AND output = 'projection_unavailable' THEN 'projection_unavailable' WHEN NOT served THEN 'blocked' WHEN role = 'core_estimated' THEN 'native_core' WHEN role = 'projected_fundamental' THEN 'fundamental_projection' WHEN role = 'projected_returns' THEN 'returns_projection' ELSE 'served_compat' END AS quality FROM r")
def b15(spark, d):
    return roles(spark, d).select("n", "role", "path", "quality")


def roles(spark, d):
    n = F.col("n")
    rows = ids(spark, d).withColumns(
        {
            "status": L.ladder((n % 3 == 0, "core_estimated"), (n % 3 == 1, "projected_only"), otherwise="ineligible"),
            "served": n % 7 != 0,
            "output": F.when(n % 14 == 0, "projection_unavailable").otherwise("served"),
            "home": n % 6 == 0,
        }
    )
    rows = rows.withColumn("role", L.realized_role(F.col("status"), F.when(n % 4 == 0, "projected").otherwise("native"), F.when(n % 5 == 0, "returns_projection").otherwise(""), F.lit("")))
    no = F.lit(False)
    return rows.withColumns({"path": L.policy_path(F.col("role"), n % 2 == 0, F.col("home"), n % 11 == 0, n % 13 == 0, no), "quality": L.quality_label(F.col("role"), F.col("served"), F.col("output"))})


@query("b16_gate_ledger", ROLES + " SELECT n, gate, state FROM (SELECT n, 'structural' AS gate, CASE WHEN n % 2 = 0 THEN 'passed' ELSE 'failed' END AS state FROM r UNION ALL SELECT n, 'home', CASE WHEN n % 2 <> 0 THEN 'skipped' WHEN home THEN 'passed' ELSE 'failed' END FROM r UNION ALL SELECT n, 'served', CASE WHEN n % 2 <> 0 OR NOT home THEN 'skipped' WHEN served THEN 'passed' ELSE 'failed' END FROM r)")
def b16(spark, d):
    """Gates in order: after the first that fails the rest are skipped."""
    gates = [("structural", F.col("n") % 2 == 0), ("home", F.col("home")), ("served", F.col("served"))]
    so_far, cells = F.lit(True), []
    for name, passes in gates:
        cells.append(F.struct(F.lit(name).alias("gate"), F.when(~so_far, "skipped").when(passes, "passed").otherwise("failed").alias("state")))
        so_far = so_far & passes
    return roles(spark, d).select("n", F.explode(F.array(*cells)).alias("g")).select("n", "g.gate", "g.state")


@query("b17_overlay_downgrade", ROLES + " SELECT n, CASE WHEN n % 11 = 0 AND n % 5 = 0 AND served THEN 'ineligible' ELSE role END AS role, CASE WHEN n % 11 = 0 AND n % 5 = 0 AND served THEN 'projection_unavailable' ELSE output END AS output FROM r")
def b17(spark, d):
    gone = (F.col("path") == "returns_projection_candidate") & (F.col("n") % 5 == 0) & F.col("served")
    return roles(spark, d).select("n", F.when(gone, "ineligible").otherwise(F.col("role")).alias("role"), F.when(gone, "projection_unavailable").otherwise(F.col("output")).alias("output"))


@query("b18_fit_status", IDS + "SELECT n, CASE WHEN n % 60 < 39 OR n % 6 > 4 THEN 'insufficient_history' WHEN n % 60 < 52 OR n % 6 > 2 THEN 'limited_history' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN n % 6 > 2 THEN 'continuity_gap' END, 'ex_us_caution') AS warnings FROM ids")
def b18(spark, d):
    n = F.col("n")
    return ids(spark, d).select("n", L.fit_status(n % 60, n % 6).alias("status"), F.array_join(L.fit_warnings(n % 6, F.col("country")), ",").alias("warnings"))


@query("b19_package_scope", IDS + "SELECT n, CASE WHEN n % 17 = 0 THEN 'factor_basis_only' WHEN scope = 'AMERICA' AND (n % 2 = 0 OR n % 3 = 0) THEN 'core_us_equity' ELSE 'extended_priced_instrument' END AS package_scope, CASE WHEN n % 4 = 0 THEN 'missing_price_on_or_before_package_date' WHEN n % 60 < 39 OR n % 6 > 4 THEN 'fit_status_insufficient_history' WHEN n % 60 < 52 OR n % 6 > 2 THEN 'fit_status_limited_history' ELSE 'ex_us_caution' END AS reason FROM ids")
def b19(spark, d):
    n = F.col("n")
    country = F.when(F.col("scope") == "AMERICA", "US").otherwise("JP")
    reason = L.coverage_reason(L.fit_status(n % 60, n % 6), n % 4 != 0, L.fit_warnings(n % 6, F.lit("JP")))
    return ids(spark, d).select("n", L.package_scope(n % 17 == 0, country, n % 2 == 0, n % 3 == 0).alias("package_scope"), reason.alias("reason"))


@query("b20_coverage_label", IDS + "SELECT n, CASE WHEN n % 9 = 0 THEN 'missing_cpar_fit' WHEN n % 5 = 0 THEN 'covered' WHEN n % 4 = 0 THEN 'missing_price' WHEN n % 7 = 0 THEN 'insufficient_history' ELSE 'covered' END AS label FROM ids")
def b20(spark, d):
    n = F.col("n")
    return ids(spark, d).select("n", L.coverage_label(n % 9 != 0, F.when(n % 5 == 0, "covered").otherwise(""), F.when(n % 7 == 0, "insufficient_history").otherwise("ok"), F.when(n % 4 != 0, F.col("balance"))).alias("label"))


@query("b21_price_pick", "SELECT ric, date, round(coalesce(CASE WHEN volume % 2 = 0 THEN close * 0.5 END, close), 6) AS price, CASE WHEN volume % 2 = 0 THEN 'adj_close' ELSE 'close' END AS field FROM prices")
def b21(spark, d):
    adjusted = F.when(F.col("volume") % 2 == 0, F.col("close") * 0.5)
    return A.prices(spark, d).select("ric", "date", sql_round(F.coalesce(adjusted, "close"), 6).alias("price"), F.when(adjusted.isNotNull(), "adj_close").otherwise("close").alias("field"))


@query("b22_confidence", IDS + ", c AS (SELECT n, ((n % 2 = 0)::INT + (n % 3 = 0)::INT + (n % 5 <> 0)::INT + 1) / 4.0 AS s FROM ids) SELECT n, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.75 THEN 'medium' ELSE 'low' END AS band, s < 0.75 AS degraded FROM c")
def b22(spark, d):
    n = F.col("n")
    rows = ids(spark, d).withColumns({"d1": F.when(n % 2 == 0, 1.0), "d2": F.when(n % 3 == 0, 1.0), "d3": F.when(n % 5 != 0, 1.0), "d4": F.lit(1.0)})
    band, _, degraded = L.confidence(["d1", "d2", "d3", "d4"])
    return rows.select("n", band.alias("band"), degraded.alias("degraded"))


@query("b23_loading_threshold", IDS + "SELECT n, CASE WHEN n % 4 <> 0 AND abs(balance / 1e5) < 0.05 THEN 0 ELSE round(balance / 1e5, 8) END AS loading FROM ids")
def b23(spark, d):
    return ids(spark, d).select("n", sql_round(L.thresholded(F.col("balance") / 1e5, F.col("n") % 4 == 0), 8).alias("loading"))


@query("b24_short_sector", IDS + "SELECT n, CASE n % 4 WHEN 0 THEN 'Matls' WHEN 1 THEN 'ConsDef' WHEN 2 THEN left(sector, 8) ELSE 'SofITSer' END AS short FROM ids")
def b24(spark, d):
    n = F.col("n")
    name = L.ladder((n % 4 == 0, F.lit("basic  materials")), (n % 4 == 1, F.lit(" Consumer Non-Cyclicals ")), (n % 4 == 2, F.col("sector")), otherwise="Software & IT Services")
    return ids(spark, d).select("n", L.short_sector(name).alias("short"))


@query("b25_risk_tier", IDS + "SELECT n, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN 'active_package_limited' WHEN n % 2 = 0 AND n % 3 = 1 THEN 'active_package_insufficient' WHEN n % 2 = 0 AND n % 5 = 0 THEN 'active_package_core' WHEN n % 2 = 0 THEN 'active_package_extended' WHEN n % 7 = 0 THEN 'registry_core_target' WHEN n % 11 = 0 THEN 'registry_extended_target' ELSE 'limited_info' END AS tier FROM ids")
def b25(spark, d):
    n = F.col("n")
    status = L.ladder((n % 3 == 0, "limited_history"), (n % 3 == 1, "insufficient_history"), otherwise="ok")
    return ids(spark, d).select("n", L.weekly_tier(n % 2 == 0, status, F.when(n % 5 == 0, "core_us_equity").otherwise("extended"), n % 7 == 0, n % 11 == 0).alias("tier"))
