"""What is served and watched: diagnostics by date, weekly histories, snapshots, scopes, searches, membership and package checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numbers import sql_round
from . import crosssection as X
from . import relational as R
from . import timeseries as T

#: A t-statistic that counts as a hit, days of the turnover's mean, and days that mean needs.
HIT, TURNOVER_DAYS, LEAST_DAYS = 2.0, 60, 3
#: Members that may be missing at all, that may be missing whatever their share, and the share beyond.
MOST_MISSING, FEW_MISSING, MISSING_SHARE = 25, 5, 0.05
#: Origins of exposures that a projected security may be served with.
PROJECTED = ["projected", "projected_returns", "projected_fundamental"]


def hit_rate(rows: DataFrame, factor: str = "factor_name", t: str = "t") -> DataFrame:
    """(factor, hit_rate): percent of days whose absolute t-statistic is above HIT."""
    return rows.groupBy(factor).agg((F.avg(F.when(F.abs(t) > HIT, 1.0).otherwise(0.0)) * 100).alias("hit_rate"))


def breadth(rows: DataFrame, date: str, is_style: Column, t: str = "t") -> DataFrame:
    """(date, style, other): mean absolute t-statistics of styles and of all other factors."""
    return rows.groupBy(date).agg(F.avg(F.when(is_style, F.abs(t))).alias("style"), F.avg(F.when(~is_style, F.abs(t))).alias("other"))


def exposure_turnover(exposures: DataFrame, date: str, key: str) -> DataFrame:
    """(date, turnover, roll60, raw_turnover, interval_days) of dates but the first. exposures: (date, key, factor_name, exposure).

    Mean absolute change from the date before over all factors and all keys of either date, where what is missing counts
    as 0, by calendar days between both. Each exposure is added to its own date and taken from the next, so changes are
    sums and no date is joined with another.
    """
    days = exposures.select(date).distinct()
    order = Window.orderBy(date)  # one row a date
    days = days.withColumns({"_next": F.lead(date).over(order), "_before": F.lag(date).over(order)})
    factors = exposures.agg(F.count_distinct("factor_name").alias("_factors"))
    sides = F.array(F.struct(F.col(date).alias("_at"), F.col("exposure").alias("_x")), F.struct(F.col("_next").alias("_at"), (-F.col("exposure")).alias("_x")))
    parts = exposures.join(days.select(date, "_next"), date).select(key, "factor_name", F.inline(sides)).where("_at is not null")
    changes = parts.groupBy("_at", key, "factor_name").agg(F.abs(F.sum("_x")).alias("_c")).groupBy("_at", key).agg(F.sum("_c").alias("_c"))
    by_day = changes.groupBy("_at").agg(F.sum("_c").alias("_c"), F.count("*").alias("_n")).join(days.select(F.col(date).alias("_at"), "_before"), "_at").where("_before is not null")
    raw = by_day.join(F.broadcast(factors)).select(F.col("_at").alias(date), (F.col("_c") / (F.col("_n") * F.col("_factors"))).alias("raw_turnover"), F.greatest(F.lit(1), F.datediff("_at", "_before")).alias("interval_days"))
    rows = raw.withColumn("turnover", F.col("raw_turnover") / F.col("interval_days"))
    last = Window.orderBy(date).rowsBetween(1 - TURNOVER_DAYS, 0)  # one row a date
    return rows.withColumn("roll60", F.when(F.count("turnover").over(last) >= LEAST_DAYS, F.avg("turnover").over(last)).otherwise(F.col("turnover")))


def block_r2(rows: DataFrame, date: str, ret: str, cap: str, residual: str, style_fitted: str) -> DataFrame:
    """(date, full_r2, structural_r2, incremental_r2) with root-cap weights; the structural residual is the full one and what styles explain."""
    w, y, e = F.sqrt(F.greatest(F.col(cap), F.lit(0.0))), F.col(ret), F.col(residual)
    mean = rows.groupBy(date).agg(F.try_divide(F.sum(w * y), F.sum(w)).alias("_mean"))
    s = e + F.coalesce(F.col(style_fitted), F.lit(0.0))
    sums = rows.join(mean, date).groupBy(date).agg(F.sum(w * (y - F.col("_mean")) ** 2).alias("_t"), F.sum(w * e * e).alias("_e"), F.sum(w * s * s).alias("_s"))
    r2 = lambda c: F.when(F.col("_t") > 0, 1 - F.col(c) / F.col("_t")).otherwise(0.0)
    return sums.select(date, r2("_e").alias("full_r2"), r2("_s").alias("structural_r2"), (r2("_e") - r2("_s")).alias("incremental_r2"))


def weekly_history(prices: DataFrame, fundamentals: DataFrame, registry: DataFrame, *, first: str | None = None, last: str | None = None, lag: int = 21, long_lag: int = 252) -> DataFrame:
    """Raw cross-sections of the last session of each week, as one plan.

    Price features of every row, what was known of the security's fundamentals on the date and its classification give
    size and momentum, their scores over rows that are structurally eligible, the reasons of the others, and the band of
    confidence. first and last bound the sessions that come out, not the prices that features look back on.
    """
    features = T.price_features(prices, lag=lag, long_lag=long_lag)
    session = T.week_friday(F.col("date"), False)
    asked = prices
    if first:
        asked = asked.where(F.col("date") >= first)
    if last:
        asked = asked.where(F.col("date") <= last)
    sessions = asked.groupBy(session.alias("_week")).agg(F.max("date").alias("date")).select("date")
    base = features.join(sessions, "date").select("ric", "date", "close", "momentum_raw", "resid_vol_raw", "log_adv")
    known = R.asof_backward(base, fundamentals, "ric", "date", "as_of_date", ["seq"], ["market_cap"])
    rows = known.join(registry.select("ric", "sector", "country"), "ric", "left").withColumn("size_raw", F.when(F.col("market_cap") > 0, F.log("market_cap")))
    reasons = L.structural_reasons(F.col("size_raw").isNotNull(), F.col("market_cap"), F.col("sector"), F.col("sector"), F.col("country"))
    band, depth, degraded = L.confidence(["size_raw", "momentum_raw", "resid_vol_raw", "log_adv"])
    rows = rows.withColumns({"reasons": reasons, "band": band, "fallback_depth": depth, "degraded": degraded})
    good = rows.where("reasons = ''")
    for raw, style in (("size_raw", "size"), ("momentum_raw", "momentum")):
        good = X.standardized(good, ["date"], raw, "market_cap", style)
    none = F.lit(None).cast("double")
    return good.unionByName(rows.where("reasons <> ''").withColumns({"size": none, "momentum": none}))


def raw_sections(prices: DataFrame, fundamentals: DataFrame, registry: DataFrame, *, least: int = 30, lag: int = 21, long_lag: int = 252) -> DataFrame:
    """(date, ric, cap, industry, core, reasons, descriptors): raw cross-sections of the last session of each week with `least` core rows or more.

    Descriptors are of prices up to the session and of what was known of fundamentals on it (fundamentals: ric, as_of_date, seq and the
    columns of X.fundamental_ratios that prices don't give). A row is core if nothing keeps it out of the structural universe.
    """
    features = T.price_features(prices, lag=lag, long_lag=long_lag)
    sessions = prices.groupBy(T.week_friday(F.col("date"), False).alias("_week")).agg(F.max("date").alias("date")).select("date")
    base = features.join(F.broadcast(sessions), "date").select("ric", "date", F.col("close").alias("price_close"), "momentum_raw", "st_reversal_raw", "resid_vol_raw", F.col("log_adv").alias("log_avg_dollar_volume_20d_raw"), F.col("avg_volume_short").alias("avg_volume_21d"), F.col("avg_volume_year").alias("avg_volume_252d"))
    known = R.asof_backward(base, fundamentals, "ric", "date", "as_of_date", ["seq"], [c for c in fundamentals.columns if c not in ("ric", "as_of_date", "seq")])
    rows = X.fundamental_ratios(known.join(registry.select("ric", F.col("sector").alias("industry"), "country"), "ric", "left").withColumnRenamed("market_cap", "cap").withColumn("market_cap", F.col("cap")))
    reasons = L.structural_reasons(F.col("size_raw").isNotNull(), F.col("cap"), F.col("industry"), F.col("industry"), F.col("country"))
    rows = rows.withColumn("reasons", reasons).withColumn("core", F.col("reasons") == "")
    covered = rows.where("core").groupBy("date").count().where(F.col("count") >= least).select("date")
    return rows.join(covered, "date", "left_semi").select("date", "ric", "cap", "industry", "core", "reasons", *[c for c in rows.columns if c.endswith("_raw")])


def dates_to_compute(sessions: DataFrame, caches: list[DataFrame], date: str, counts: DataFrame, least: int) -> DataFrame:
    """(date): sessions from the first with `least` usable rows on that not all caches hold. counts: (date, n)."""
    first = counts.where(F.col("n") >= least).agg(F.min(date).alias("_first"))
    cached = reduce(lambda a, b: a.join(b.select(date).distinct(), date, "left_semi"), caches[1:], caches[0].select(date).distinct())
    return sessions.select(date).distinct().join(F.broadcast(first)).where(F.col(date) >= F.col("_first")).drop("_first").join(cached, date, "left_anti")


def base_sections(history: DataFrame, mode: str) -> DataFrame:
    """(ric, ticker, as_of_date) in capitals: every distinct row in mode full, else each ric's last date with its greatest ticker."""
    rows = history.select(F.upper("ric").alias("ric"), F.upper(F.coalesce("ticker", F.lit(""))).alias("ticker"), "as_of_date")
    return rows.distinct() if mode == "full" else rows.groupBy("ric").agg(F.max("ticker").alias("ticker"), F.max("as_of_date").alias("as_of_date"))


def snapshot(base: DataFrame, facts: dict[str, tuple[DataFrame, str, list[str], list[str]]], mode: str) -> DataFrame:
    """base with the columns of each table of facts: as of the row's date in mode full, else of each ric's last row up to the last date of base.

    facts: name -> (rows with ric, date, order, columns); the date comes out as <name>_date.
    """
    for name, (rows, date, order, columns) in facts.items():
        rows = rows.withColumnRenamed(date, f"{name}_date")
        if mode == "full":
            base = R.asof_backward(base, rows, "ric", "as_of_date", f"{name}_date", order, columns)
        else:
            end = base.agg(F.max("as_of_date").alias("_end"))
            recent = rows.join(F.broadcast(end)).where(F.col(f"{name}_date") <= F.col("_end"))
            newest = R.latest_wide(recent, ["ric"], [f"{name}_date", *order], columns)
            base = base.join(newest.select("ric", f"{name}_date", *columns), "ric", "left")
    return base


def _active(df: DataFrame) -> DataFrame:
    here = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return df.where((F.coalesce(F.nullif(F.trim("tracking"), F.lit("")), F.lit("active")) == "active") & here("ric") & here("ticker"))


def scope(df: DataFrame, name: str) -> DataFrame:
    """(ric, ticker) of a named scope of active securities: identifier_refresh, price_ingest, returns_projection, weekly_build or pit_ingest.

    df: ric, ticker, tracking, exchange, source and 0/1 flags price_enabled, pit_enabled, equity, classified, projection,
    core, extended; degraded for those with degraded recent prices. pit_ingest takes pending seeds all, others by best
    suffix and ric of each ticker.
    """
    rows = _active(df).withColumns({"ric": F.upper(F.trim("ric")), "ticker": F.upper(F.trim("ticker"))})
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    sound = L.source_exclusion(F.col("ric"), F.col("ticker"), F.col("exchange"))
    sound = F.coalesce(sound, F.lit("")) == ""
    if name == "identifier_refresh":
        out = rows
    elif name == "price_ingest":
        out = rows.where(on("price_enabled") & sound).dropDuplicates(["ric"])
    elif name == "returns_projection":
        out = rows.where(on("projection"))
    elif name == "weekly_build":
        out = rows.where(on("core") | on("extended"))
    elif name == "pit_ingest":
        pending = ~on("classified") & F.coalesce(F.col("source"), F.lit("")).endswith("_seed") & ~on("projection")
        listed = rows.where(~pending & on("pit_enabled") & on("equity") & on("classified") & ~on("degraded") & sound)
        best = R.latest(listed, ["ticker"], [L.suffix_rank(F.col("ric")).asc(), F.col("ric").asc()])
        out = rows.where(pending).unionByName(best)
    else:
        raise ValueError(f"unknown scope {name}")
    return out.select("ric", "ticker")


def compatibility_view(registry: DataFrame, policy: DataFrame, taxonomy: DataFrame, observed: DataFrame) -> DataFrame:
    """(ric, ticker, classification_ok, is_equity_eligible, coverage_role) of registry rows that aren't disabled; a taxonomy goes before the last observation.

    registry: ric, ticker, tracking; policy: ric, projection, pit_fundamentals, pit_classification; taxonomy: ric, ready,
    equity; observed: ric, as_of_date, updated, ready, equity. Flags are 0 or 1.
    """
    ric = F.upper(F.trim("ric")).alias("ric")
    rows = registry.where((F.coalesce(F.trim("ric"), F.lit("")) != "") & (F.coalesce(F.nullif(F.trim("tracking"), F.lit("")), F.lit("active")) != "disabled"))
    rows = rows.select(ric, F.upper(F.trim("ticker")).alias("ticker"))
    seen = R.latest_wide(observed.withColumn("ric", ric), ["ric"], ["as_of_date", "updated"], ["ready", "equity"]).select("ric", F.col("ready").alias("_ready"), F.col("equity").alias("_equity"))
    rows = rows.join(policy.withColumn("ric", ric), "ric", "left").join(taxonomy.withColumn("ric", ric), "ric", "left").join(seen, "ric", "left")
    flag = lambda *c: F.coalesce(*c, F.lit(0))
    only = (flag("projection") == 1) & (flag("pit_fundamentals") == 0) & (flag("pit_classification") == 0)
    return rows.select("ric", "ticker", flag("ready", "_ready").alias("classification_ok"), (flag("equity", "_equity") == 1).cast("int").alias("is_equity_eligible"), F.when(only, "projection_only").otherwise("native_equity").alias("coverage_role"))


def reconciled_policies(policies: DataFrame, structure: DataFrame, defaults: list[str]) -> DataFrame:
    """(ric, policy_source, flags): policies whose source is a default (or blank), with the flags that follow from the structure; others are left alone.

    structure: ric, role, kind, scope, single.
    """
    source = F.coalesce(F.nullif(F.lower(F.trim("policy_source")), F.lit("")), F.lit("registry_seed_defaults"))
    rows = policies.select("ric", source.alias("policy_source")).where(F.col("policy_source").isin(defaults)).join(structure, "ric")
    return rows.select("ric", "policy_source", L.policy_flags(F.col("role"), F.col("kind"), F.col("scope"), F.col("single")).alias("flags"))


def universe_loadings(exposures: DataFrame, covariance: DataFrame, projected: DataFrame, scope: DataFrame, *, key: str = "ric") -> DataFrame:
    """(key, factors, risk_loading, model_status, exposure_origin) of every key of scope, a struct (factor_name, exposure, sensitivity) a factor.

    A key without native exposures takes projected ones, and one without either is ineligible with no loading.
    A sensitivity is exposure by factor volatility, the risk loading the sum of their sizes. exposures and projected:
    (key, factor_name, exposure).
    """
    vols = covariance.where("factor_name = factor_name_2").select("factor_name", F.sqrt(F.greatest("covariance", F.lit(0.0))).alias("_vol"))
    native = exposures.select(key, "factor_name", "exposure", F.lit("native").alias("_origin"))
    more = projected.join(exposures.select(key).distinct(), key, "left_anti").select(key, "factor_name", "exposure", F.lit("projected").alias("_origin"))
    rows = native.unionByName(more).join(vols, "factor_name", "left").withColumn("_s", sql_round(F.col("exposure") * F.coalesce("_vol", F.lit(0.0)), 6))
    cells = F.sort_array(F.collect_list(F.struct("factor_name", "exposure", F.col("_s").alias("sensitivity"))))
    by = rows.groupBy(key).agg(cells.alias("factors"), sql_round(F.sum(F.abs("_s")), 6).alias("risk_loading"), F.max("_origin").alias("exposure_origin"))
    status = F.when(F.col("exposure_origin") == "native", "core_estimated").when(F.col("exposure_origin") == "projected", "projected_only").otherwise("ineligible")
    return scope.select(key).distinct().join(by, key, "left").withColumn("model_status", status)


def membership_coverage(served: DataFrame, members: DataFrame, by: str, key: str) -> DataFrame:
    """(by, matched, missing, ok): served keys that membership has, and whether those it lacks are few enough to publish."""
    both = served.select(by, key).distinct().join(members.select(by, key).distinct().withColumn("_in", F.lit(True)), [by, key], "left")
    out = both.groupBy(by).agg(F.count("_in").alias("matched"), F.count(F.when(F.col("_in").isNull(), 1)).alias("missing"))
    share = F.col("missing") / F.greatest(F.lit(1), F.col("matched") + F.col("missing"))
    return out.withColumn("ok", (F.col("missing") <= MOST_MISSING) & ((F.col("missing") <= FEW_MISSING) | (share <= MISSING_SHARE)))


def search_rank(term: str) -> list[Column]:
    """Keys to order by: exact, prefix and part of ticker, then of ric, then of name. df: ticker, ric, display_name."""
    t, r, n = (F.upper(F.coalesce(c, F.lit(""))) for c in ("ticker", "ric", "display_name"))
    x = F.lit(term.upper())
    at = lambda c: F.locate(term.upper(), c) - 1
    steps = [(t == x, 0, F.lit(0)), (r == x, 0, F.lit(1)), (t.startswith(x), 1, F.length(t)), (r.startswith(x), 1, F.length(r)), (at(t) >= 0, 2, at(t)), (at(r) >= 0, 2, at(r)), (n.startswith(x), 3, F.length(n))]
    tier = reduce(lambda c, s: c.when(s[0], s[1]), steps[1:], F.when(steps[0][0], steps[0][1])).otherwise(4)
    place = reduce(lambda c, s: c.when(s[0], s[2]), steps[1:], F.when(steps[0][0], steps[0][2])).otherwise(at(n))
    return [tier, place, t]


def search(package: DataFrame, registry: DataFrame, term: str, limit: int) -> DataFrame:
    """The best rows that hold the term in ticker, ric or name, of the package and of what only the registry has; the package goes first among equals."""
    first = package.select("ric", "ticker", "display_name", F.lit(0).alias("source_order"))
    more = registry.join(package.select("ric"), "ric", "left_anti").select("ric", "ticker", "display_name", F.lit(1).alias("source_order"))
    rows = first.unionByName(more)
    rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.upper(c).contains(term.upper()), F.lit(False)) for c in ("ticker", "ric", "display_name")]))
    tier, place, ticker = search_rank(term)
    ranked = rows.withColumns({"tier": tier, "place": place, "_t": ticker})
    return ranked.orderBy("tier", "place", "_t", "source_order", "ric").limit(limit).drop("_t")


def watermarks(pairs: dict[str, tuple[DataFrame, DataFrame, str]], run: str) -> DataFrame:
    """(table, run, source_first, source_last, target_first, target_last, target_rows) of each synchronised table: source, target and their date."""
    out = None
    for name, (source, target, date) in sorted(pairs.items()):
        one = source.agg(F.min(date).alias("source_first"), F.max(date).alias("source_last")).join(F.broadcast(target.agg(F.min(date).alias("target_first"), F.max(date).alias("target_last"), F.count("*").alias("target_rows"))))
        one = one.select(F.lit(name).alias("table"), F.lit(run).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def proxy_issues(specs: DataFrame, proxies: DataFrame, anchored: DataFrame) -> DataFrame:
    """(factor_id, issue): factors whose ticker has no proxy or several, or whose only proxy has no price in the anchor week.

    specs: (factor_id, ticker); proxies: (ticker, ric); anchored: (ric) with a price.
    """
    found = proxies.groupBy("ticker").agg(F.count("*").alias("_n"), F.min("ric").alias("ric"))
    priced = anchored.select("ric").distinct().withColumn("_priced", F.lit(True))
    rows = specs.join(found, "ticker", "left").join(priced, "ric", "left")
    issue = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(F.col("_priced").isNull(), "no_terminal_price")
    return rows.select("factor_id", issue.alias("issue")).where("issue is not null")


def projection_issues(projected: DataFrame, universe: DataFrame, book: DataFrame) -> DataFrame:
    """(ticker, place, model_status, exposure_origin): projected tickers that aren't served as such in the universe, or in the book if they are held."""
    known = lambda df: df.select("ticker", "model_status", "exposure_origin")
    wrong = (F.coalesce("model_status", F.lit("")) != "projected_only") | ~F.coalesce("exposure_origin", F.lit("")).isin(PROJECTED)
    asked = projected.select("ticker").distinct()
    both = asked.join(known(universe), "ticker", "left").withColumn("place", F.lit("universe")).unionByName(asked.join(known(book), "ticker").withColumn("place", F.lit("portfolio")))
    missing = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing")).alias(c)
    return both.where(wrong).select("ticker", "place", missing("model_status"), missing("exposure_origin"))


def weekly_positions(positions: DataFrame, loadings: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """(account, key, weight, contributions): weights over covered gross value of each covered position, with its part in each factor, largest first.

    positions: market_value, covered; loadings: (key, factor_id, loading). Parts of at most 1e-12 are left out.
    """
    covered = positions.where(F.col("covered") & F.col("market_value").isNotNull())
    gross = F.sum(F.abs("market_value")).over(Window.partitionBy(account))
    rows = covered.select(account, key, F.when(gross > 0, F.col("market_value") / gross).otherwise(0.0).alias("weight"))
    part = (F.col("weight") * F.col("loading")).alias("part")
    parts = rows.join(loadings, key).select(account, key, "factor_id", part).where(F.abs("part") > 1e-12)
    order = F.sort_array(F.collect_list(F.struct((-F.abs("part")).alias("size"), "factor_id", "part")))
    listed = parts.groupBy(account, key).agg(F.transform(order, lambda p: F.struct(p["factor_id"].alias("factor_id"), p["part"].alias("part"))).alias("contributions"))
    return rows.join(listed, [account, key], "left")


def aggregate_loadings(rows: DataFrame, *, account: str = "account") -> DataFrame:
    """(account, factor_id, loading, n) of weekly positions."""
    each = rows.select(account, F.inline("contributions"))
    return each.groupBy(account, "factor_id").agg(F.sum("part").alias("loading"), F.count("*").alias("n"))


def staged(payloads: dict[str, DataFrame], snapshot_id: str) -> DataFrame:
    """(snapshot, name, place, payload): rows of each payload as JSON under one snapshot; place is the row's hash, so a restaged row keeps it."""
    out = None
    for name, df in sorted(payloads.items()):
        text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        one = df.select(F.lit(snapshot_id).alias("snapshot"), F.lit(name).alias("name"), F.md5(text).alias("place"), text.alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def restamped(rows: DataFrame, schemas: dict[str, str], stamps: dict[str, str], snapshot_id: str) -> DataFrame:
    """Staged rows under a new snapshot; payloads named in schemas (name -> its columns as DDL) carry the stamps, which replace fields they had under these names. Others stay as they were."""
    payload, read = F.col("payload"), {}
    for i, (name, schema) in enumerate(sorted(schemas.items())):
        at = f"_read{i}"
        read[at] = F.when(F.col("name") == name, F.from_json("payload", schema))
        names = rows.select(read[at].alias(at)).schema[at].dataType.names
        # The parsed payload is a column of its own, as an expression it would be parsed again for each field (so does withField).
        fields = [F.lit(stamps[c]).alias(c) if c in stamps else F.col(at)[c].alias(c) for c in names] + [F.lit(v).alias(c) for c, v in sorted(stamps.items()) if c not in names]
        payload = F.when(F.col("name") == name, F.to_json(F.when(F.col(at).isNotNull(), F.struct(*fields)), {"ignoreNullFields": "false"})).otherwise(payload)
    rows = rows.withColumns(read) if read else rows
    return rows.withColumn("payload", payload).select(F.lit(snapshot_id).alias("snapshot"), "name", F.md5("payload").alias("place"), "payload")
