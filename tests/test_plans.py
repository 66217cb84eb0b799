"""Registered queries against DuckDB on the small tables, and kernels against closed forms."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import crosssection as X
from factorloom.operators import portfolio as P
from factorloom.operators import riskmodel as M
from factorloom.plans import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:26]
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    cur = duck.execute(registry.ORACLES[name])
    columns = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_others_run(spark, small, name):
    registry.QUERIES[name](spark, small).collect()


def test_whole_grids(spark, small):
    """All dates are filled, and securities of all sectors have runtimes."""
    from factorloom.sources import adapters as A

    assert registry.QUERIES["c03_asof_fill_all"](spark, small).count() == A.long_prices(spark, small).count()
    sectors = lambda rics: {r.sector for r in A.registry(spark, small).join(rics, "ric", "left_semi").select("sector").distinct().collect()}
    assert sectors(registry.QUERIES["c20_runtime_by_date_all"](spark, small)) == sectors(A.fundamentals(spark, small)) != {"BUILDING"}


def test_constrained_regression():
    """Cap-weighted industry returns add up to 0, and planted coefficients come back."""
    rng = np.random.default_rng(0)
    industries = np.eye(3)[rng.integers(0, 3, 200)]
    style, caps = rng.normal(size=(200, 1)), rng.uniform(1, 9, 200)
    planted = np.array([0.02, -0.01, 0.005])
    planted -= (industries.T @ caps) @ planted / caps.sum()
    fit = X.one_stage(0.01 + industries @ planted + 0.3 * style[:, 0], caps, industries, style)
    assert np.allclose(fit["beta"], [0.01, *planted, 0.3])
    assert abs((industries.T @ caps) @ fit["beta"][1:4]) < 1e-8 and fit["r2"] == pytest.approx(1)


def test_standardized(spark):
    """Against the same rules in pandas; a group without spread gives 0."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 50), "x": np.concatenate([rng.normal(size=50), np.ones(50)]), "cap": rng.uniform(1, 5, 100)})
    pdf.loc[3, "x"] = 40.0
    out = X.standardized(spark.createDataFrame(pdf), ["g"], "x", "cap", "z").toPandas()
    a = out[out.g == "a"]
    med = a.x.median()
    mad = (a.x - med).abs().median()
    clipped = a.x.clip(med - 3 * mad, med + 3 * mad)
    z = ((clipped - np.average(clipped, weights=a.cap)) / clipped.std(ddof=0)).clip(-5, 5)
    assert np.allclose(a.z, z) and (out[out.g == "b"].z == 0).all()


def test_covariance_and_projection(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2024-01-01", periods=120).date
    f = rng.normal(0, 0.01, (120, 2))
    factors = spark.createDataFrame([(d, n, float(x)) for d, row in zip(days, f) for n, x in zip("AB", row)], "date date, factor_name string, factor_return double")
    cov = M.factor_covariance(factors).toPandas().pivot(index="factor_name", columns="factor_name_2", values="covariance").to_numpy()
    assert np.allclose(cov, M.covariance_of(f), rtol=1e-9, atol=1e-14)
    assert np.allclose(cov, cov.T) and (np.linalg.eigvalsh(cov) > 0).all() and np.allclose(np.diag(cov), M.YEAR * f.var(0), rtol=0.3)
    ret = f @ [1.0, -0.2]
    returns = spark.createDataFrame([("x", d, float(r)) for d, r in zip(days, ret)] + [("short", days[0], 0.1)], "ric string, date date, ret double")
    out = M.returns_projection(returns, factors).select("ric", "status", "factor_name", F.round("loading", 9).alias("loading"), "obs").collect()
    assert {tuple(r) for r in out} == {("x", "ok", "A", 1.0, 120), ("x", "ok", "B", -0.2, 120), ("short", "no_core_date_return", None, None, 1)}


def test_projection_leaves_gaps_out(spark):
    """A date on which a factor is missing is no date of the fit; dates after the core date don't count."""
    rng = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", periods=100).date
    f = rng.normal(0, 0.01, (100, 2))
    factors = spark.createDataFrame([(d, n, float(x)) for i, (d, row) in enumerate(zip(days, f)) for n, x in zip("AB", row) if not (n == "B" and i in (5, 50))], "date date, factor_name string, factor_return double")
    ret = f @ [2.0, 0.5]
    ret[95:] = 9.0  # later than the core date
    returns = spark.createDataFrame([("x", d, float(r)) for d, r in zip(days, ret)] + [("few", d, 0.1) for d in days[60:95]] + [("late", days[97], 0.1)], "ric string, date date, ret double")
    out = M.returns_projection(returns, factors, core_date=str(days[94])).select("ric", "status", "factor_name", F.round("loading", 9).alias("loading"), "obs").collect()
    assert {tuple(r) for r in out} == {("x", "ok", "A", 2.0, 93), ("x", "ok", "B", 0.5, 93), ("few", "insufficient_history", None, None, 35), ("late", "no_core_date_return", None, None, 0)}


def test_covariance_of_gaps(spark):
    """Factors with missing days, and fewer days than lags, against the matrix form."""
    rng = np.random.default_rng(5)
    for n in (2, 3, 40):
        f = rng.normal(0, 0.02, (n, 3))
        f[0, 1] = f[-1, 2] = 0.0
        days = pd.date_range("2024-01-01", periods=n).date
        rows = [(d, name, float(x)) for d, row in zip(days, f) for name, x in zip("ABC", row) if x]
        cov = M.factor_covariance(spark.createDataFrame(rows, "date date, factor_name string, factor_return double")).toPandas().pivot(index="factor_name", columns="factor_name_2", values="covariance")
        assert np.allclose(cov.to_numpy(), M.covariance_of(f), rtol=1e-8, atol=1e-12)


def test_style_order_ignores_column_order():
    assert X.style_order(["Momentum", "Size"]) == X.style_order(["Size", "Momentum"]) == ["Size", "Momentum"]


def test_pruned_hedge(spark):
    """Of two correlated factors the smaller loading goes; the market stays and legs are capped."""
    loads = {"M": 1.2, "A": 0.5, "B": 0.4, "C": -0.3, "D": 0.2, "E": 0.1, "F": 0.04}
    cov = spark.createDataFrame([(f, g, 1.0 if f == g else 0.95 if {f, g} == {"A", "B"} else 0.1) for f in loads for g in loads], "factor_name string, factor_name_2 string, covariance double")
    rows = spark.createDataFrame([("x", f, b) for f, b in loads.items()], "ric string, factor_name string, loading double")
    legs = {r["factor_name"]: r["weight"] for r in P.uncorrelated_legs(rows, cov, "M", legs=4).collect()}
    assert legs == {"M": -1.2, "A": -0.5, "C": 0.3, "D": -0.2}


def test_stability(spark):
    legs = lambda *rows: spark.createDataFrame(rows, "ric string, factor_name string, weight double")
    (row,) = P.stability(legs(("x", "A", 1.0), ("x", "B", -0.5)), legs(("x", "A", 0.5))).collect()
    assert (row["overlap"], row["gross_change"], row["net_change"]) == (0.5, 1.0, 0.0)
    rows = P.stability(legs(("new", "A", 1.0), ("flat", "A", 0.0), ("gone", "A", 0.0)), legs(("flat", "A", 0.0), ("gone", "A", 2.0))).collect()
    assert {tuple(r) for r in rows} == {("new", None, None, None), ("flat", 1.0, 0.0, 0.0), ("gone", 0.0, 2.0, 2.0)}


def test_duplicate_scenario_rows_fail(spark):
    rows = spark.createDataFrame([("a", "x", 1)], "account string, ric string, quantity long")
    with pytest.raises(Exception, match="duplicate scenario row"):
        P.applied(rows, rows.union(rows)).collect()


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len({r.date for r in rows}) > 10 and {"Market", "Size", "Value"} <= {r.factor_name for r in rows}


def test_ridge_fits(spark):
    """Planted coefficients without penalties, and normal equations with them."""
    from factorloom.operators import weekly as K

    rng = np.random.default_rng(4)
    market, x, w = rng.normal(size=40), rng.normal(size=(40, 3)), 0.5 ** (np.arange(40) / 26)
    x[:, 2] = 1.0  # no scale: dropped
    groups = {"a": "sector", "b": "style", "c": "style"}
    ret = 0.1 + 0.8 * market + x[:, :2] @ [0.5, -0.3]
    df = spark.createDataFrame([("s", k, float(ret[k]), float(market[k]), float(w[k])) for k in range(40)], "ric string, week int, ret double, market double, weight double")
    f = spark.createDataFrame([(k, n, float(x[k, i])) for k in range(40) for i, n in enumerate(groups)], "week int, factor_id string, residual double")
    free = K.ridge_fits(df, f, "ric", groups, penalties={"sector": 0.0, "style": 0.0}).collect()
    assert [(r.alpha, r.market_beta, r.n) for r in free] == [pytest.approx((0.1, 0.8, 40))] * 3
    assert {r.factor_id: r.beta for r in free} == pytest.approx({"a": 0.5, "b": -0.3, "c": 0.0})
    v = w / w.sum()
    z = (x[:, :2] - v @ x[:, :2]) / np.sqrt(v @ (x[:, :2] - v @ x[:, :2]) ** 2)
    design = np.column_stack([np.ones(40), market, z])
    expected = np.linalg.solve((design.T * v) @ design + np.diag([0, 0, 1.0, 2.0]), (design.T * v) @ ret)
    one = K.ridge_fits(df, f, "ric", groups).collect()
    assert one[0].market_beta == pytest.approx(expected[1])
    assert {r.factor_id: r.beta for r in one if r.factor_id != "c"} == pytest.approx(dict(zip("ab", expected[2:] / np.sqrt(v @ (x[:, :2] - v @ x[:, :2]) ** 2), strict=True)))
    line = np.polyfit(market, ret, 1, w=np.sqrt(v))
    left = ret - np.polyval(line, market)
    block = np.linalg.solve((design[:, [0, 2, 3]].T * v) @ design[:, [0, 2, 3]] + np.diag([0, 4.0, 8.0]), (design[:, [0, 2, 3]].T * v) @ left)
    two = K.ridge_fits(df, f, "ric", groups, two_step=True).collect()
    assert two[0].market_beta == pytest.approx(line[0])
    assert {r.factor_id: r.beta for r in two if r.factor_id != "c"} == pytest.approx(dict(zip("ab", block[1:] / np.sqrt(v @ (x[:, :2] - v @ x[:, :2]) ** 2), strict=True)))
