"""Column functions for identifiers, eligibility, policies, statuses and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NON_EQUITY_SECTORS = ["Exchange Traded Fund", "Digital Asset"]
BLANK_WORDS = ["nan", "None", "Unmapped"]
US_SUFFIXES_ESTIMATION = ["N", "O", "A", "K", "P", "PK", "Q"]
US_SUFFIXES_MEMBERSHIP = ["N", "OQ", "O", "A", "K", "P", "PK", "Q"]
SUFFIX_RANKS = [(".N", 0), (".OQ", 1), (".O", 2), (".K", 3), (".P", 4)]
SECTOR_SHORT = {
    "BASIC MATERIALS": "Matls",
    "CONSUMER CYCLICALS": "ConsCyc",
    "CONSUMER NON-CYCLICALS": "ConsDef",
    "ENERGY": "Energy",
    "FINANCIALS": "Fins",
    "HEALTHCARE": "Health",
    "INDUSTRIALS": "Inds",
    "REAL ESTATE": "RealEst",
    "TECHNOLOGY": "Tech",
    "TELECOMMUNICATION SERVICES": "Telco",
    "UTILITIES": "Utils",
}
POLICY_FLAGS = [
    "price_ingest_enabled",
    "pit_fundamentals_enabled",
    "pit_classification_enabled",
    "allow_cuse_native_core",
    "allow_cuse_fundamental_projection",
    "allow_cuse_returns_projection",
    "allow_cpar_core_target",
    "allow_cpar_extended_target",
]
# The flags of POLICY_FLAGS that hold, by kind of security.
NATIVE_POLICY = ["price_ingest_enabled", "pit_fundamentals_enabled", "pit_classification_enabled", "allow_cuse_native_core", "allow_cpar_core_target", "allow_cpar_extended_target"]
POLICIES = {
    "native": NATIVE_POLICY,
    "us": NATIVE_POLICY,
    "ex_us": ["price_ingest_enabled", "pit_fundamentals_enabled", "pit_classification_enabled", "allow_cuse_fundamental_projection", "allow_cpar_extended_target"],
    "fund": ["price_ingest_enabled", "allow_cuse_returns_projection", "allow_cpar_extended_target"],
    "other": ["price_ingest_enabled", "allow_cpar_extended_target"],
}


def ladder(*steps: tuple, otherwise=None) -> Column:
    """The value of the first condition that holds; conditions that are null don't hold."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def optional_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def identifier(c: Column) -> Column:
    return F.upper(optional_text(c))


def ticker_of(ric: Column) -> Column:
    return F.nullif(F.substring_index(identifier(ric), ".", 1), F.lit(""))


def clean_text(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.isin(*BLANK_WORDS), "").otherwise(t)


def source_exclusion(ric: Column, ticker: Column, exchange: Column) -> Column:
    r, t, x = identifier(ric), F.coalesce(identifier(ticker), F.lit("")), F.coalesce(identifier(exchange), F.lit(""))
    return ladder(
        (r.isNull(), "missing_ric"),
        (r.contains("^"), "lineage_ric"),
        (t.contains("*"), "alias_ticker"),
        (x.contains("CONSOLIDATED"), "consolidated_exchange"),
        (x.contains("PINK SHEETS"), "pink_sheets"),
        (x.contains("WHEN TRADING"), "secondary_when_trading"),
        (x.contains(" PSX") | x.startswith("NASDAQ OMX PSX"), "secondary_psx"),
    )


def structural_reasons(has_style: Column, cap: Column, sector: Column, business: Column, country: Column) -> Column:
    """Reasons that keep a security out, joined by |; empty if it is eligible. A missing business sector has its old name."""
    has_cap = F.coalesce(~F.isnan(cap) & (cap > 0) & (cap < float("inf")), F.lit(False))
    missing = [(~has_style, "missing_style"), (~has_cap, "missing_market_cap"), (clean_text(sector) == "", "missing_trbc_economic_sector_short"), (clean_text(business) == "", "missing_trbc_industry"), (clean_text(country) == "", "missing_country"), (clean_text(sector).isin(*NON_EQUITY_SECTORS), "non_equity")]
    return F.concat_ws("|", *[F.when(c, name) for c, name in missing])


def country_of_suffix(ric: Column, suffixes: list[str]) -> Column:
    r = F.upper(F.trim(ric))
    return F.when(r.contains(".") & F.substring_index(r, ".", -1).isin(*suffixes), "US").otherwise("")


def suffix_rank(ric: Column) -> Column:
    return ladder(*[(F.upper(ric).endswith(s), F.lit(k)) for s, k in SUFFIX_RANKS], otherwise=99)


def drop_reason(native: Column, single: Column, ready: Column, observations: Column, cap: Column, classified: Column, price: Column, adv: Column, *, least_observations: int = 252, least_price: float = 2.0, least_cap: float = 250e6, least_adv: float = 1e6) -> Column:
    """Why a security isn't in the estimation universe, the first of nine checks that fails; empty if none."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return ladder(
        (no(native), "not_native_core_candidate"),
        (no(single), "not_single_name_equity"),
        (no(ready), "missing_classification"),
        (no(observations >= least_observations), "missing_price_history"),
        (no(cap > 0), "missing_fundamentals"),
        (no(classified), "missing_trbc"),
        (no(price >= least_price), "price_floor"),
        (no(cap >= least_cap), "microcap"),
        (no(adv >= least_adv), "illiquid"),
        otherwise="",
    )


def model_status(core: Column, projectable: Column) -> Column:
    return ladder((core, "core_estimated"), (projectable, "projected_only"), otherwise="ineligible")


def slug(c: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(text == "", "unknown").otherwise(text)


def factor_id(name: Column, family: Column, source: Column) -> Column:
    return ladder(((family == "style") & source.isNotNull(), F.concat(F.lit("style_"), slug(source))), (family == "market", F.lit("market")), (family == "industry", F.concat(F.lit("industry_"), slug(name))), otherwise=slug(name))


def policy_flags(role: Column, kind: Column, scope: Column, single: Column) -> Column:
    """A struct of POLICY_FLAGS from what a security is."""
    k, s = F.coalesce(optional_text(kind), F.lit("other")), F.coalesce(optional_text(scope), F.lit("unknown"))
    is_single = F.coalesce(single, F.lit(0)) == 1
    family = ladder(
        (optional_text(role) == "projection_only", "fund"),
        ((k == "other") & (s == "unknown") & ~is_single, "native"),
        (k == "fund_vehicle", "fund"),
        (is_single & (s == "unknown"), "native"),
        (is_single & (s == "us"), "us"),
        (is_single & (s == "ex_us"), "ex_us"),
        otherwise="other",
    )
    return F.struct(*[family.isin([f for f, flags in POLICIES.items() if name in flags]).cast("int").alias(name) for name in POLICY_FLAGS])


def taxonomy(role: Column, sector: Column, country: Column, ready: Column, eligible: Column) -> Column:
    """A struct of instrument_kind, vehicle_structure, scope and is_single_name_equity; a classification decides before what was observed."""
    sec, home = optional_text(sector), F.upper(optional_text(country))
    classified = sec.isNotNull() | home.isNotNull()
    single = F.when(classified, ~F.coalesce(sec.isin(*NON_EQUITY_SECTORS), F.lit(False))).otherwise((F.coalesce(ready, F.lit(0)) == 1) & (F.coalesce(eligible, F.lit(0)) == 1))
    case = ladder((role == "projection_only", 0), (sec.isin(*NON_EQUITY_SECTORS), 1), (single, 2), otherwise=3)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), case)
    return F.struct(
        pick(["fund_vehicle", "fund_vehicle", "single_name_equity", "other"]).alias("instrument_kind"),
        pick(["projection_only_vehicle", "classified_non_equity", "equity_security", "other"]).alias("vehicle_structure"),
        ladder((home == "US", "us"), (home.isNotNull(), "ex_us"), otherwise="unknown").alias("scope"),
        (case == 2).cast("int").alias("is_single_name_equity"),
    )


def realized_role(status: Column, origin: Column, reason: Column, method: Column) -> Column:
    by_returns = origin.isin("projected", "projected_returns") | reason.isin("returns_projection", "projected_returns_regression", "projection_unavailable") | (F.coalesce(method, F.lit("")) != "")
    return ladder((status == "core_estimated", "core_estimated"), ((status == "projected_only") & by_returns, "projected_returns"), (status == "projected_only", "projected_fundamental"), otherwise="ineligible")


def policy_path(role: Column, structural: Column, home: Column, returns: Column, fundamental: Column, native: Column) -> Column:
    return ladder(
        (returns, "returns_projection_candidate"),
        (fundamental, "fundamental_projection_candidate"),
        (native, "native_core_candidate"),
        (structural & ~home, "fundamental_projection_candidate"),
        ((role == "core_estimated") | home, "native_core_candidate"),
        otherwise="untracked",
    )


def quality_label(role: Column, served: Column, output: Column) -> Column:
    return ladder(
        (~served & (output == "projection_unavailable"), "projection_unavailable"),
        (~served, "blocked"),
        (role == "core_estimated", "native_core"),
        (role == "projected_fundamental", "fundamental_projection"),
        (role == "projected_returns", "returns_projection"),
        otherwise="served_compat",
    )


def fit_status(observed: Column, gap: Column, *, least: int = 39) -> Column:
    return ladder(((observed < least) | (gap > 4), "insufficient_history"), ((observed < 52) | (gap > 2), "limited_history"), otherwise="ok")


def fit_warnings(gap: Column, country: Column) -> Column:
    home = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    return F.array_compact(F.array(F.when(gap > 2, "continuity_gap"), F.when(~home.isin("", "US"), "ex_us_caution")))


def package_scope(proxy: Column, country: Column, core: Column, single: Column) -> Column:
    return ladder((proxy, "factor_basis_only"), ((country == "US") & (core | single), "core_us_equity"), otherwise="extended_priced_instrument")


def coverage_reason(status: Column, priced: Column, warnings: Column) -> Column:
    return ladder((~priced, F.lit("missing_price_on_or_before_package_date")), (status == "insufficient_history", F.lit("fit_status_insufficient_history")), (status == "limited_history", F.lit("fit_status_limited_history")), (F.size(warnings) > 0, F.get(warnings, F.lit(0))), otherwise="ok")


def coverage_label(has_fit: Column, use: Column, status: Column, price: Column) -> Column:
    return ladder((~has_fit, "missing_cpar_fit"), (use.isin("covered", "missing_price", "insufficient_history"), use), (price.isNull(), "missing_price"), (status == "insufficient_history", "insufficient_history"), otherwise="covered")


def confidence(descriptors: list[str]) -> tuple[Column, Column, Column]:
    """Band, fallback depth and degraded flag from how many descriptors are there."""
    share = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in descriptors]) / F.lit(float(len(descriptors)))
    return ladder((share >= 0.9, "high"), (share >= 0.75, "medium"), otherwise="low"), ladder((share >= 0.9, 0), (share >= 0.75, 1), otherwise=2), share < 0.75


def thresholded(loading: Column, is_market: Column, threshold: float = 0.05) -> Column:
    return F.when(~is_market & (F.abs(loading) < threshold), 0.0).otherwise(loading)


def short_sector(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    key = F.trim(F.regexp_replace(F.upper(F.regexp_replace(raw, "&", " AND ")), " +", " "))
    tokens = F.filter(F.split(F.regexp_replace(raw, "&", " "), r"\s+"), lambda x: x != "")
    compact = F.array_join(F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2))), "")
    made = ladder((F.size(tokens) == 0, F.substring(raw, 1, 8)), (F.size(tokens) == 1, F.substring(F.get(tokens, F.lit(0)), 1, 8)), otherwise=F.substring(compact, 1, 8))
    known = F.create_map(*[F.lit(x) for pair in SECTOR_SHORT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), made)


def weekly_tier(active: Column, status: Column, scope: Column, core: Column, extended: Column) -> Column:
    return ladder(
        (active & (status == "limited_history"), "active_package_limited"),
        (active & (status == "insufficient_history"), "active_package_insufficient"),
        (active & F.lower(scope).contains("core"), "active_package_core"),
        (active, "active_package_extended"),
        (core, "registry_core_target"),
        (extended, "registry_extended_target"),
        otherwise="limited_info",
    )
