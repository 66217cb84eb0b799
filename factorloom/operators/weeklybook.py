"""Books of the weekly family: positions with fits, factor variances, charts, shares, risk mixes, snapshots and hedges of single positions.

Everything is long: parts are one row by position and factor, a book's metrics one row a factor. Sums by book combine before
the shuffle, so a book with a third of all positions is no single group; only its few factors meet in pairs. Positions are
(account, ric, quantity), fits (ric, fit_status, use_status, specific_variance), loadings (ric, factor_id, loading), factors
(factor_id, family, place) with the families market, sector and style. Rows with a null account or ric keep their row as
a position without a fit, and have no part in any sum by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.numbers import sql_round
from . import portfolio as P

#: Fixed value: loadings, parts and variances that count as nothing.
TINY = 1e-12
#: Families of factors and the names of their shares.
SHARES = {"market": "market", "sector": "industry", "style": "style"}


def all_accounts(positions: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """(account, key, quantity): quantities over all accounts as one book, without those that cancel out."""
    total = positions.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("quantity").alias("quantity"))
    return total.where(F.abs("quantity") > TINY).select(F.lit("all_accounts").alias(account), key, "quantity")


def position_rows(positions: DataFrame, fits: DataFrame, prices: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """positions with price, market_value, coverage, specific_variance and weight: of the book's covered gross value, null where not covered.

    fits and prices (key, price) have one row a key at most.
    """
    fitted = fits.select(key, "fit_status", "use_status", "specific_variance", F.lit(True).alias("_fit"))
    rows = positions.select(account, key, "quantity").join(fitted, key, "left").join(prices.select(key, "price"), key, "left")
    label = L.coverage_label(F.coalesce("_fit", F.lit(False)), F.coalesce("use_status", F.lit("")), F.coalesce("fit_status", F.lit("")), F.col("price"))
    rows = rows.withColumns({"market_value": F.col("quantity") * F.col("price"), "coverage": label}).drop("_fit")
    worth = F.when(F.col("coverage") == "covered", F.col("market_value"))
    gross = rows.groupBy(account).agg(F.sum(F.abs(worth)).alias("covered_gross"))
    return rows.join(gross, account, "left").withColumn("weight", F.when(F.col("covered_gross") > 0, worth / F.col("covered_gross")))


def parts(rows: DataFrame, loadings: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """(account, key, weight, factor_id, part): what each covered position adds to its book's loading."""
    held = rows.where("weight is not null").select(account, key, "weight")
    return held.join(loadings.select(key, "factor_id", "loading"), key).select(account, key, "weight", "factor_id", (F.col("weight") * F.col("loading")).alias("part"))


def book_loadings(rows: DataFrame, *, account: str = "account") -> DataFrame:
    """(account, factor_id, loading) of parts, without loadings that cancel out."""
    return rows.groupBy(account, "factor_id").agg(F.sum("part").alias("loading")).where(F.abs("loading") > TINY)


def specific(rows: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """(account, key, specific): squared weight by specific variance of covered positions that have both."""
    each = rows.select(account, key, (F.col("weight") * F.col("weight") * F.col("specific_variance")).alias("specific"))
    return each.where(F.abs("specific") > TINY)


def adjusted(books: DataFrame, covariance: DataFrame, *, account: str = "account") -> DataFrame:
    """books (account, factor_id, loading) with own, the factor's variance, and adjustment, its covariance with the book.

    A pair of a book's factors that the covariance doesn't have raises: a variance of what is left would be too low.
    """
    other = books.select(account, F.col("factor_id").alias("factor_id_2"), F.col("loading").alias("_with"))
    cells = books.select(account, "factor_id").join(covariance.select("factor_id", "factor_id_2", "covariance"), "factor_id").join(other, [account, "factor_id_2"])
    sums = cells.groupBy(account, "factor_id").agg(F.sum(F.col("covariance") * F.col("_with")).alias("adjustment"), F.max(F.when(F.col("factor_id") == F.col("factor_id_2"), F.col("covariance"))).alias("own"), F.count("*").alias("_met"))
    size = books.groupBy(account).agg(F.count("*").alias("_size"))
    rows = books.select(account, "factor_id", "loading").join(size, account).join(sums, [account, "factor_id"], "left")
    lost = F.raise_error(F.concat(F.lit("covariance lacks pairs of "), "factor_id")).cast("double")
    return rows.select(account, "factor_id", "loading", "own", F.when(F.coalesce("_met", F.lit(0)) == F.col("_size"), F.col("adjustment")).otherwise(lost).alias("adjustment"))


def factor_metrics(books: DataFrame, covariance: DataFrame, idio: DataFrame, *, account: str = "account") -> DataFrame:
    """By account and factor: loading, volatility, adjustment, contribution to variance, its share of the total, and the total with the specific part.

    idio: (account, specific) of positions. A total that isn't positive has null shares.
    """
    rows = adjusted(books, covariance, account=account).withColumn("contribution", F.col("loading") * F.col("adjustment"))
    whole = rows.groupBy(account).agg(F.sum("contribution").alias("_factors"))
    alone = idio.groupBy(account).agg(F.sum("specific").alias("_idio"))
    rows = rows.join(whole, account).join(alone, account, "left")
    total = F.col("_factors") + F.coalesce("_idio", F.lit(0.0))
    volatility = F.sqrt(F.greatest("own", F.lit(0.0)))
    return rows.select(account, "factor_id", "loading", volatility.alias("volatility"), "adjustment", "contribution", F.when(total > 0, F.col("contribution") / total).alias("share"), total.alias("total"))


def chart(each: DataFrame, metrics: DataFrame, factors: DataFrame, *, account: str = "account") -> DataFrame:
    """By account and factor of any part: family, place, loading, its long and short parts, how many positions, volatility, sensitivity, adjustment, contribution and share.

    A factor whose parts cancel out is there with a loading of 0 and no risk.
    """
    size = F.col("part")
    sides = each.where(F.abs(size) > TINY).groupBy(account, "factor_id").agg(F.sum(F.when(size > 0, size).otherwise(0.0)).alias("long_part"), F.sum(F.when(size < 0, size).otherwise(0.0)).alias("short_part"), F.count("*").alias("n"))
    rows = sides.join(metrics, [account, "factor_id"], "full").join(factors.select("factor_id", "family", "place"), "factor_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    figures = ["loading", "long_part", "short_part", "volatility", "adjustment", "contribution", "share"]
    return rows.select(account, "factor_id", "family", "place", F.coalesce("n", F.lit(0)).alias("n"), *map(zero, figures), (F.coalesce("loading", F.lit(0.0)) * F.coalesce("volatility", F.lit(0.0))).alias("sensitivity"))


def drilldown(each: DataFrame, metrics: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """By account, factor and position: loading of the position, part, both by the factor's volatility and by its covariance with the book, and percent of the book's variance."""
    rows = each.where(F.abs("part") > TINY).join(metrics.select(account, "factor_id", "volatility", "adjustment", "total"), [account, "factor_id"], "left")
    vol, adjustment = F.coalesce("volatility", F.lit(0.0)), F.coalesce("adjustment", F.lit(0.0))
    loading = F.when(F.abs("weight") > TINY, F.col("part") / F.col("weight")).otherwise(0.0)
    percent = F.when(F.col("total") > TINY, F.col("part") * adjustment / F.col("total") * 100).otherwise(0.0)
    return rows.select(account, "factor_id", key, "weight", "part", loading.alias("loading"), (loading * vol).alias("scaled_loading"), (F.col("part") * vol).alias("scaled_part"), (loading * adjustment).alias("adjusted_loading"), percent.alias("risk_percent"))


def _by_family(rows: DataFrame, factors: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, market, industry, style): sums of value by the factors' families."""
    rows = rows.join(factors.select("factor_id", "family"), "factor_id")
    return rows.groupBy(*by).agg(*[F.sum(F.when(F.col("family") == family, value).otherwise(0.0)).alias(name) for family, name in SHARES.items()])


def _with_idio(families: DataFrame, idio: DataFrame, by: list[str]) -> DataFrame:
    rows = families.join(idio, by, "full")
    return rows.select(*by, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in [*SHARES.values(), "idio"]])


def risk_shares(metrics: DataFrame, idio: DataFrame, factors: DataFrame, *, account: str = "account") -> DataFrame:
    """(account, market, industry, style, idio): percent of the total variance, contributions with their sign; all 0 where there is none."""
    families = _by_family(metrics, factors, [account], F.col("contribution"))
    rows = _with_idio(families, idio.groupBy(account).agg(F.sum("specific").alias("idio")), [account])
    names = [*SHARES.values(), "idio"]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return rows.select(account, *[F.when(total > TINY, F.col(c) / total * 100).otherwise(0.0).alias(c) for c in names])


def vol_scaled_shares(metrics: DataFrame, idio: DataFrame, factors: DataFrame, *, account: str = "account") -> DataFrame:
    """(account, market, industry, style, idio): percent of the absolute sensitivities and the specific volatility, 2 places; nothing at all is all idio."""
    families = _by_family(metrics, factors, [account], F.abs(F.col("loading") * F.col("volatility")))
    rows = _with_idio(families, idio.groupBy(account).agg(F.sqrt(F.greatest(F.sum("specific"), F.lit(0.0))).alias("idio")), [account])
    names = [*SHARES.values(), "idio"]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return rows.select(account, *[F.when(total > TINY, sql_round(F.col(c) / total * 100, 2)).otherwise(100.0 if c == "idio" else 0.0).alias(c) for c in names])


def risk_mix(each: DataFrame, metrics: DataFrame, idio: DataFrame, factors: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """(account, key, market, industry, style, idio): percent of a position's absolute contributions; positions without any have no row."""
    by = [account, key]
    rows = each.where(F.abs("part") > TINY).join(metrics.select(account, "factor_id", "adjustment"), [account, "factor_id"])
    size = F.abs(F.col("part") * F.col("adjustment"))
    both = _with_idio(_by_family(rows, factors, by, F.when(size > TINY, size).otherwise(0.0)), idio.select(*by, F.abs("specific").alias("idio")), by)
    names = [*SHARES.values(), "idio"]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return both.withColumn("_total", total).where(F.col("_total") > TINY).select(*by, *[(F.col(c) / F.col("_total") * 100).alias(c) for c in names])


def snapshots(rows: DataFrame, metrics: DataFrame, idio: DataFrame, accounts: DataFrame | None = None, *, account: str = "account") -> DataFrame:
    """By account: status (ok, partial, unavailable, or empty for one of accounts without positions), reason, counts, gross, net, covered gross, coverage ratio, and factor, specific and total variance."""
    covered = F.col("coverage") == "covered"
    worth = F.col("market_value")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    out = rows.groupBy(account).agg(
        F.count("*").alias("n"), F.count(F.when(covered, 1)).alias("covered_n"), zero(F.sum(F.abs(worth)), "gross"), zero(F.sum(F.when(covered, worth)), "net"), zero(F.sum(F.when(covered, F.abs(worth))), "covered_gross")
    )
    if accounts is not None:
        out = accounts.select(account).distinct().join(out, account, "left").na.fill(0).na.fill(0.0)
    out = out.join(metrics.groupBy(account).agg(F.sum("contribution").alias("factor_variance")), account, "left").join(idio.groupBy(account).agg(F.sum("specific").alias("idio_variance")), account, "left")
    usable = (F.col("covered_n") > 0) & (F.col("covered_gross") > 0)
    status = F.when(F.col("n") == 0, "empty").when(~usable, "unavailable").when(F.col("covered_n") < F.col("n"), "partial").otherwise("ok")
    reason = F.when(status == "empty", "no_positions").when(status == "unavailable", "nothing_covered").when(status == "partial", "some_excluded")
    factor, alone = (F.coalesce(c, F.lit(0.0)) for c in ("factor_variance", "idio_variance"))
    return out.select(
        account, status.alias("status"), reason.alias("reason"), "n", "covered_n", (F.col("n") - F.col("covered_n")).alias("excluded_n"), "gross", "net", "covered_gross", F.when(F.col("gross") > 0, F.col("covered_gross") / F.col("gross")).alias("coverage_ratio"),
        factor.alias("factor_variance"), alone.alias("idio_variance"), (factor + alone).alias("total_variance"),
    )


def unhedged(fits: DataFrame, *, key: str = "ric") -> DataFrame:
    """(key, reason) of the fits that mustn't be hedged: without a price, or with too short a history."""
    use, status = F.coalesce("use_status", F.lit("")), F.coalesce("fit_status", F.lit(""))
    reason = F.when(use.isin("missing_price", "insufficient_history"), F.concat(F.lit("hedge_use_status_"), use)).when(status == "insufficient_history", "fit_status_insufficient_history")
    return fits.select(key, reason.alias("reason")).where("reason is not null")


def hedges(loadings: DataFrame, covariance: DataFrame, market: str, fits: DataFrame, *, key: str = "ric") -> tuple[DataFrame, DataFrame]:
    """Market-neutral and factor-neutral hedges of each key long one unit: legs (key, mode, factor_id, weight) and previews, one row by key and mode.

    Previews: status, reason, reduction of the loadings but the market's, gross and net weight, and the variance of the
    factors before and after. All rules are even in the loadings, so a short position has the same with legs of the other
    sign, and a security is hedged once however many books hold it. Fits that mustn't be hedged have no legs, no reduction
    and the status hedge_unavailable.
    """
    blocked = unhedged(fits, key=key)
    rows = loadings.join(blocked, key, "left_anti").select(key, F.col("factor_id").alias("factor_name"), "loading")
    one = P.market_neutral(rows, market, key=key)
    many = P.uncorrelated_legs(rows, covariance.select(F.col("factor_id").alias("factor_name"), F.col("factor_id_2").alias("factor_name_2"), "covariance"), market, key=key)
    single = one.where("weight <> 0").select(key, F.lit("market_neutral").alias("mode"), F.lit(market).alias("factor_id"), "weight")
    legs = single.unionByName(many.select(key, F.lit("factor_neutral").alias("mode"), F.col("factor_name").alias("factor_id"), "weight"))
    any_ = P.candidates(rows, market).select(key).distinct().withColumn("_any", F.lit(True))
    cut = P.reduction(rows, many, key=key, without=market).join(any_, key, "left")
    none = F.col("_any").isNull()
    reason = F.when(none, "no_material_factor_exposures").when(F.col("status") == "hedge_degraded", "residual_factor_exposures_remain_after_pruning")
    heads = one.select(key, F.lit("market_neutral").alias("mode"), "status", "reason", F.lit(1.0).alias("reduction"))
    heads = heads.unionByName(cut.select(key, F.lit("factor_neutral").alias("mode"), F.when(none, "hedge_ok").otherwise(F.col("status")).alias("status"), reason.alias("reason"), F.when(none, 1.0).otherwise(F.col("reduction")).alias("reduction")))
    modes = F.explode(F.array(F.lit("market_neutral"), F.lit("factor_neutral"))).alias("mode")
    shut = blocked.join(loadings, key, "left_semi").select(key, modes, F.lit("hedge_unavailable").alias("status"), "reason", F.lit(None).cast("double").alias("reduction"))
    heads = heads.unionByName(shut)
    notional = legs.groupBy(key, "mode").agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    after = hedged_loadings(loadings, legs, key=key)
    # Before and after as two books of one key, so that both variances are one pass over pairs of factors.
    both = after.select(F.struct(key, "mode").alias("_book"), "factor_id", F.inline(F.array(F.struct(F.lit(0).alias("_when"), F.col("before").alias("loading")), F.struct(F.lit(1).alias("_when"), F.col("after").alias("loading")))))
    both = both.select(F.struct(F.col("_book").alias("of"), F.col("_when").alias("at")).alias("_book"), "factor_id", "loading")
    variance = adjusted(both, covariance, account="_book").groupBy("_book").agg(F.sum(F.col("loading") * F.col("adjustment")).alias("v"))
    at = lambda k: F.max(F.when(F.col("_book.at") == k, F.col("v")))
    variance = variance.groupBy(F.col(f"_book.of.{key}").alias(key), F.col("_book.of.mode").alias("mode")).agg(at(0).alias("variance_before"), at(1).alias("variance_after"))
    previews = heads.join(notional, [key, "mode"], "left").join(variance, [key, "mode"], "left")
    return legs, previews.select(key, "mode", "status", "reason", "reduction", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("gross", "net", "variance_before", "variance_after")])


def hedged_loadings(loadings: DataFrame, legs: DataFrame, *, key: str = "ric") -> DataFrame:
    """(key, mode, factor_id, before, leg, after) of both modes, for every factor that a key loads on; legs are always of these."""
    modes = F.explode(F.array(F.lit("market_neutral"), F.lit("factor_neutral"))).alias("mode")
    rows = loadings.select(key, "factor_id", F.col("loading").alias("before"), modes).join(legs.select(key, "mode", "factor_id", F.col("weight").alias("leg")), [key, "mode", "factor_id"], "left")
    leg = F.coalesce("leg", F.lit(0.0))
    return rows.select(key, "mode", "factor_id", "before", leg.alias("leg"), (F.col("before") + leg).alias("after"))


def position_trades(rows: DataFrame, legs: DataFrame, proxies: DataFrame, *, account: str = "account", key: str = "ric") -> DataFrame:
    """(account, key, mode, factor_id, weight, notional, trade_quantity): hedges of each covered position that is worth something, sized by its value.

    legs are of one unit long; proxies: (factor_id, price). A leg whose proxy has no price of more than nothing has no quantity.
    """
    held = rows.where((F.col("coverage") == "covered") & (F.abs("market_value") > 0)).select(account, key, F.signum("market_value").alias("_side"), F.abs("market_value").alias("_base"))
    sized = held.join(legs, key).join(proxies.select("factor_id", F.col("price").alias("_price")), "factor_id", "left")
    weight = F.col("weight") * F.col("_side")
    notional = weight * F.col("_base")
    return sized.select(account, key, "mode", "factor_id", weight.alias("weight"), notional.alias("notional"), F.when(F.abs("_price") > TINY, notional / F.col("_price")).alias("trade_quantity"))


def security_details(fits: DataFrame, prices: DataFrame, registry: DataFrame, loadings: DataFrame, *, key: str = "ric") -> DataFrame:
    """One row for each security of the package or the registry: name, source, tier, price and how many loadings count.

    fits: key, fit_status, use_status; registry: key, display_name. A package's row is served before the registry's, and
    what has no fit is known by the registry only and can't be staged.
    """
    counted = loadings.where(F.abs("loading") > TINY).groupBy(key).agg(F.count("*").alias("loadings"))
    rows = fits.select(key, "fit_status", F.lit(True).alias("_fit")).join(registry.select(key, "display_name", F.lit(True).alias("_listed")), key, "full")
    rows = rows.join(prices.select(key, "price"), key, "left").join(counted, key, "left")
    fitted = F.col("_fit").isNotNull()
    tier = F.when(~fitted, "registry_only").when(F.col("fit_status") == "insufficient_history", "not_estimated").otherwise("estimated")
    return rows.select(key, F.coalesce("display_name", key).alias("display_name"), F.when(fitted, "active_package").otherwise("registry").alias("source"), tier.alias("tier"), "price", F.coalesce("loadings", F.lit(0)).alias("loadings"), fitted.alias("can_be_staged"))
