"""Sections of the health diagnostics against numpy and pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import health as E


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_histograms(spark):
    """Bins as numpy has them; a constant group, nulls and nan, and values on an edge."""
    rng = np.random.default_rng(1)
    groups = {"a": [*rng.normal(size=200).tolist(), None, float("nan")], "b": [3.0] * 5, "c": [0.0, 1.0, 0.5, 0.25]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {(r["g"], r["place"]): (r["x"], r["n"]) for r in E.histograms(rows, "g", "v", 8).collect()}
    assert len(got) == 24
    for g, vs in groups.items():
        x = np.array([v for v in vs if v is not None and v == v])
        low, high = np.percentile(x, 1), np.percentile(x, 99)
        low, high = (low, high) if high > low else (low - 1, high + 1)
        counts, edges = np.histogram(x, bins=8, range=(low, high))
        for i in range(8):
            assert got[g, i][1] == counts[i] and close(got[g, i][0], (edges[i] + edges[i + 1]) / 2)
    fixed = E.histograms(rows.where("g = 'a'"), "g", "v", 4, 1.0).orderBy("place").collect()
    x = np.array([v for v in groups["a"] if v is not None and v == v])
    assert [r["n"] for r in fixed] == list(np.histogram(x, bins=4, range=(-1, 1))[0])
    assert E.histograms(rows.where("g = 'z'"), "g", "v", 8).count() == 0


def test_sparse_correlations(spark):
    """As of the dense matrix; a factor that all keys have alike gives 0."""
    rng = np.random.default_rng(2)
    wide = pd.DataFrame({"Size": rng.normal(size=60), "All": 1.0})
    industry = rng.integers(0, 3, 60)
    for k in range(3):
        wide[f"I{k}"] = (industry == k).astype(float)
    cells = [(str(i), c, float(v)) for i, row in wide.iterrows() for c, v in row.items() if v]
    want = wide.corr().fillna(0.0)
    got = E.sparse_correlations(spark.createDataFrame(cells, "ric string, factor_name string, exposure double")).collect()
    assert len(got) == 25
    for r in got:
        assert close(r["correlation"], want.loc[r["factor_name"], r["factor_name_2"]])


def test_block_r2(spark):
    rng = np.random.default_rng(3)
    cap, e, s = rng.uniform(1, 9, 25), rng.normal(size=25), rng.normal(size=25)
    rows = [(day(0), "Tech", float(c), float(a), float(b)) for c, a, b in zip(cap, e, s, strict=True)]
    few = [(day(1), "Tech", 1.0, 0.1, 0.1)] * 19 + [(day(1), " ", 1.0, 0.1, 0.1)] * 5 + [(day(1), "Tech", 0.0, 0.1, 0.1)] * 5
    residuals = spark.createDataFrame(rows + few, "date date, industry string, cap double, residual double, Size double")
    returns = spark.createDataFrame([(day(0), "Size", 0.5, 0.3), (day(0), "Market", 0.1, 0.3), (day(1), "Size", 0.5, 0.3)], "date date, factor_name string, factor_return double, r_squared double")
    [got] = E.block_r2(returns, residuals, ["Size"]).collect()
    w = np.sqrt(cap) / np.sqrt(cap).sum()
    want = 1 - (w * (e + 0.5 * s) ** 2).sum() / ((w * e * e).sum() / 0.7)
    assert got["date"] == day(0) and close(got["r2_full"], 0.3) and close(got["r2_structural"], want) and close(got["r2_style_incremental"], 0.3 - want)


def test_filled_returns_and_growth(spark):
    """A factor without a return on a date has 0 there; growth is the plain running product, below -100 % too."""
    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.normal(0, 0.02, (80, 2)), index=[day(i) for i in range(80)], columns=["A", "B"])
    wide.loc[day(5), "A"], wide.loc[day(9), "A"], wide.loc[day(40), "B"] = -1.5, -1.2, -1.0
    rows = [(d, f, float(v)) for d, r in wide.iterrows() for f, v in r.items() if (d, f) != (day(7), "B")]
    wide.loc[day(7), "B"] = 0.0
    got = E.filled_returns(spark.createDataFrame(rows, "date date, factor_name string, factor_return double"))
    got = got.withColumn("total", E.growth(F.col("ret"), "factor_name", "date")).collect()
    vol, total = wide.rolling(60, min_periods=20).std() * np.sqrt(252), (1 + wide).cumprod() - 1
    assert len(got) == 160
    for r in got:
        want = vol.loc[r["date"], r["factor_name"]]
        assert r["vol"] is None if np.isnan(want) else close(r["vol"], want)
        assert close(r["total"], total.loc[r["date"], r["factor_name"]])


def test_books_and_realized_vol(spark):
    """Longs share one, shorts share minus one, and dates on which a book has no return count as 0."""
    positions = spark.createDataFrame([("1", 0.5, 50.0), ("2", 0.25, 25.0), ("3", -0.25, -25.0), ("4", 0.0, None)], "ric string, weight double, market_value double")
    books = E.model_books(positions, spark.createDataFrame([("9",)], "ric string"))
    got = {(r["account"], r["ric"]): r["weight"] for r in books.collect()}
    want = {("current", "1"): 0.5, ("current", "2"): 0.25, ("current", "3"): -0.25, ("current", "4"): 0.0, ("long_only", "1"): 0.5, ("long_only", "2"): 0.5, ("dollar_neutral", "1"): 0.5, ("dollar_neutral", "2"): 0.5, ("dollar_neutral", "3"): -1.0, ("index", "9"): 1.0}
    assert got == want
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(0, 0.02, (70, 4)), index=[day(i) for i in range(70)], columns=["1", "2", "3", "9"])
    rows = [(d, k, float(v)) for d, r in wide.iterrows() for k, v in r.items() if k != "9" or d < day(50)] + [(day(99), "7", 0.5)]
    wide.loc[day(50) :, "9"] = 0.0
    got = {r["account"]: r["realized"] for r in E.realized_vol(books, spark.createDataFrame(rows, "date date, ric string, ret double")).collect()}
    for account in ("current", "long_only", "dollar_neutral", "index"):
        w = np.array([want.get((account, k), 0.0) for k in wide.columns])
        assert close(got[account], (wide.to_numpy() @ w)[-60:].std(ddof=1) * np.sqrt(252))


def test_field_coverage(spark):
    """By hand, with keys that never report a field in the denominator and without."""
    rows = [("1", day(0), 1.0), ("1", day(1), None), ("2", day(0), 2.0), ("2", day(1), 3.0), ("3", day(0), None), ("3", day(1), None), ("3", day(9), 5.0)]
    rows = spark.createDataFrame(rows, "ric string, date date, v double")
    prices = spark.createDataFrame([("1", day(0)), ("1", day(5)), ("2", day(0)), ("2", day(5)), ("3", day(0)), ("3", day(5))], "ric string, date date")
    alive = E.in_price_life(rows, prices)
    assert alive.count() == 6
    [a] = E.field_coverage(alive, {"v": F.col("v").isNotNull()}).collect()
    assert (a["total_rows"], a["non_null_rows"], a["keys"], a["keys_below"], a["dates_below"]) == (6, 3, 3, 2, 2)
    assert close(a["row_pct"], 50) and close(a["key_pct"], 50) and close(a["key_pct_p10"], 10) and close(a["score"], 0.4 * 50 + 0.4 * 50 + 0.2 * 10)
    assert a["worst_date"] == day(1) and close(a["worst_date_pct"], 100 / 3) and close(a["date_pct"], 50)
    [b] = E.field_coverage(alive, {"v": F.col("v").isNotNull()}, expected=True).collect()
    assert (b["total_rows"], b["keys"]) == (4, 2) and close(b["row_pct"], 75) and close(b["key_pct"], 75) and b["worst_date"] == day(1) and close(b["worst_date_pct"], 50)
    assert E.field_coverage(alive.limit(0), {"v": F.col("v").isNotNull()}).count() == 0


def test_weeks_and_means(spark):
    """Weeks go from Saturday to Friday; a mean of too few weeks is the week's own value."""
    dates = [day(i) for i in range(40)]
    got = sorted(r["date"] for r in E.week_ends(spark.createDataFrame([(d,) for d in dates], "date date")).collect())
    want = pd.Series(dates, index=pd.to_datetime(dates).to_period("W-FRI")).groupby(level=0).max()
    assert got == sorted(want)
    values = pd.Series(np.arange(15.0) ** 2)
    rows = spark.createDataFrame([(day(7 * i), float(v)) for i, v in enumerate(values)], "date date, v double")
    got = [r["m"] for r in rows.withColumn("m", E.rolled("v", 12, 4)).orderBy("date").collect()]
    assert close(got, list(values.rolling(12, min_periods=4).mean().fillna(values)))
