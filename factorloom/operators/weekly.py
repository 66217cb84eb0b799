"""Weekly proxy regressions: market orthogonalisation, ridge fits of a security's weeks, and loadings of tradeable proxies.

Returns are long rows (key, week, ret) joined to the market's (week, market, weight). One-regressor fits are sums that
combine before the shuffle; a ridge fit has the weeks of one security, some 52 rows of 18 numbers, as its group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalties of the one-shot and the two-step fit by group, the least scale, and the least loading that counts.
ONE_SHOT, TWO_STEP = {"sector": 1.0, "style": 2.0}, {"sector": 4.0, "style": 8.0}
LEAST_SCALE, LEAST_LOADING = 1e-12, 0.05


def decayed(age: Column, half_life: float = 26.0) -> Column:
    """A week's weight by its age in weeks, the newest heaviest; fits don't depend on the sum of weights."""
    return F.pow(F.lit(0.5), age / half_life)


def weighted_line(df: DataFrame, by: list[str], y: str, x: str, weight: str) -> DataFrame:
    """(by, alpha, beta, n): weighted least squares on a constant and x; beta is 0 where x doesn't vary."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    s = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * a).alias("wx"), F.sum(w * b).alias("wy"), F.sum(w * a * a).alias("wxx"), F.sum(w * a * b).alias("wxy"), F.count("*").alias("n"))
    below = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    beta = F.when(below > 0, (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / below).otherwise(0.0)
    return s.select(*by, ((F.col("wy") - beta * F.col("wx")) / F.col("w")).alias("alpha"), beta.alias("beta"), "n")


def orthogonalized(df: DataFrame, by: str, y: str, market: str, weight: str) -> DataFrame:
    """df with alpha, beta and residual of its weighted line on the market, by factor. Lines are one row a factor, joined as Spark chooses."""
    lines = weighted_line(df, [by], y, market, weight).drop("n")
    return df.join(lines, by).withColumn("residual", F.col(y) - F.col("alpha") - F.col("beta") * F.col(market))


def weighted_scores(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """df with mean, scale and score of value by weights; groups whose scale is below LEAST_SCALE are left out."""
    w, x = F.col(weight), F.col(value)
    means = df.groupBy(*by).agg((F.sum(w * x) / F.sum(w)).alias("mean"))
    near = df.join(means, by)
    scales = near.groupBy(*by).agg(F.sqrt(F.sum(w * F.pow(x - F.col("mean"), F.lit(2.0))) / F.sum(w)).alias("scale")).where(F.col("scale") >= LEAST_SCALE)
    return near.join(scales, by).withColumn("score", (x - F.col("mean")) / F.col("scale"))


def ridge(y: np.ndarray, free: np.ndarray, x: np.ndarray, penalties: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Constant, coefficients of free columns, and of x in its own units; x is standardised and penalised there."""
    w = w / w.sum()
    means = w @ x
    scales = np.sqrt(w @ (x - means) ** 2)
    active = scales >= LEAST_SCALE
    design = np.column_stack([np.ones(len(y)), free, (x[:, active] - means[active]) / scales[active]])
    lhs = (design.T * w) @ design + np.diag([*[0.0] * (1 + free.shape[1]), *penalties[active]])
    solution = np.linalg.lstsq(lhs, (design.T * w) @ y, rcond=None)[0]
    beta = np.zeros(x.shape[1])
    beta[active] = solution[1 + free.shape[1] :] / scales[active]
    return float(solution[0] - beta @ means), solution[1 : 1 + free.shape[1]], beta


def ridge_fits(df: DataFrame, factors: DataFrame, key: str, groups: dict[str, str], *, two_step: bool = False, penalties: dict[str, float] | None = None) -> DataFrame:
    """(key, alpha, market_beta, factor_id, beta, n) of each security and factor.

    df: (key, week, ret, market, weight); factors: (week, factor_id, residual). Weeks that lack a factor are left out. The
    one-shot fit leaves constant and market free beside the penalised residual factors; the two-step fit takes the market
    line first and the factors from what it leaves.
    """
    names = sorted(groups)
    wide = factors.groupBy("week").pivot("factor_id", names).agg(F.first("residual")).dropna(subset=names)
    by_group = penalties or (TWO_STEP if two_step else ONE_SHOT)
    weights = np.array([by_group[groups[n]] for n in names])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        y, m, x, w = pdf["ret"].to_numpy(), pdf[["market"]].to_numpy(), pdf[names].to_numpy(), pdf["weight"].to_numpy()
        if two_step:
            alpha, market, _ = ridge(y, m, np.empty((len(y), 0)), np.empty(0), w)
            more, _, beta = ridge(y - alpha - m @ market, np.empty((len(y), 0)), x, weights, w)
            alpha += more
        else:
            alpha, market, beta = ridge(y, m, x, weights, w)
        return pd.DataFrame({key: pdf[key].iloc[0], "alpha": alpha, "market_beta": market[0], "factor_id": names, "beta": beta, "n": len(pdf)})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, "week", "ret", "market", "weight").join(wide, "week")
    return rows.groupBy(key).applyInPandas(one, f"{key} {kind}, alpha double, market_beta double, factor_id string, beta double, n long")


def trade_loadings(fits: DataFrame, lines: DataFrame, key: str, market: str, *, least: float = LEAST_LOADING) -> DataFrame:
    """(key, factor_id, loading) in terms of tradeable proxies: the market's is its beta less what the factors hold of it.

    fits: (key, market_beta, factor_id, beta); lines: (factor_id, beta) of the factors on the market. Loadings below
    `least`, but for the market's, count as 0.
    """
    held = fits.join(lines.select("factor_id", F.col("beta").alias("on_market")), "factor_id")
    own = held.groupBy(key).agg((F.max("market_beta") - F.sum(F.col("beta") * F.col("on_market"))).alias("loading")).select(key, F.lit(market).alias("factor_id"), "loading")
    cut = F.when(F.abs("beta") < least, 0.0).otherwise(F.col("beta"))
    return own.unionByName(held.select(key, "factor_id", cut.alias("loading")))


def weighted_covariance(factors: DataFrame, value: str, weight: str) -> DataFrame:
    """(factor_id, factor_id_2, covariance, correlation) over weeks; factors: (week, factor_id, value, weight), each week with all factors."""
    w, x = F.col(weight), F.col(value)
    means = factors.groupBy("factor_id").agg((F.sum(w * x) / F.sum(w)).alias("mean"))
    centred = factors.join(means, "factor_id").select("week", "factor_id", w.alias("w"), (x - F.col("mean")).alias("x"))
    other = centred.select("week", F.col("factor_id").alias("factor_id_2"), F.col("x").alias("x2"))
    cells = centred.join(other, "week").groupBy("factor_id", "factor_id_2").agg((F.sum(F.col("w") * F.col("x") * F.col("x2")) / F.sum("w")).alias("covariance"))
    own = cells.where("factor_id = factor_id_2").select("factor_id", F.sqrt(F.greatest("covariance", F.lit(0.0))).alias("vol"))
    vols = cells.join(own, "factor_id").join(own.select(F.col("factor_id").alias("factor_id_2"), F.col("vol").alias("vol2")), "factor_id_2")
    both = F.col("vol") * F.col("vol2")
    return vols.select("factor_id", "factor_id_2", "covariance", F.when(both > 0, F.col("covariance") / both).otherwise(0.0).alias("correlation"))


def display_weights(hedges: DataFrame, proxies: DataFrame, loadings: DataFrame, key: str, *, tiny: float = 1e-12) -> DataFrame:
    """(key, factor_id, weight): hedge weights through what their proxies load on; factors whose proxy has no fit stand for themselves.

    hedges: (key, factor_id, weight); proxies: (factor_id, proxy); loadings: (proxy, factor_id, loading).
    """
    own = loadings.select("proxy", F.col("factor_id").alias("shown"), "loading")
    parts = hedges.join(proxies, "factor_id").join(own, "proxy", "left")
    parts = parts.select(key, F.coalesce("shown", "factor_id").alias("factor_id"), (F.col("weight") * F.coalesce("loading", F.lit(1.0))).alias("weight"))
    return parts.groupBy(key, "factor_id").agg(F.sum("weight").alias("weight")).where(F.abs("weight") > tiny)
