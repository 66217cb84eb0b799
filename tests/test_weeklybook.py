"""Books of the weekly family against plain numpy, and their edges."""

import numpy as np
import pytest

from factorloom.operators import weeklybook as B

FACTORS = [("M", "market", 1), ("T", "sector", 2), ("E", "sector", 3), ("V", "style", 4)]
SIGMA = np.array([[0.04, 0.01, 0.00, 0.005], [0.01, 0.09, 0.02, 0.0], [0.0, 0.02, 0.05, 0.01], [0.005, 0.0, 0.01, 0.03]])
LOADS = {"a": [1.0, 0.5, 0.0, -0.2], "b": [0.8, 0.0, 0.3, 0.0], "c": [1.2, -0.5, 0.1, 0.4], "s": [0.5, 0.2, 0.2, 0.2]}
HELD = [("x", "a", 10), ("x", "b", -5), ("x", "c", 7), ("x", "n", 3), ("x", None, 9), ("y", "a", -4), ("y", "s", 6), ("z", "n", 1), (None, "a", 2)]
PRICES = {"a": 20.0, "b": 30.0, "s": 5.0, "n": 9.0, "c": 11.0}
SPECIFIC = {"a": 0.1, "b": 0.2, "c": None, "s": 0.3}


@pytest.fixture(scope="module")
def tables(spark):
    of = spark.createDataFrame
    names = [f for f, *_ in FACTORS]
    cov = of([(f, g, float(SIGMA[i, j])) for i, f in enumerate(names) for j, g in enumerate(names)], "factor_id string, factor_id_2 string, covariance double")
    loads = of([(k, f, v) for k, row in LOADS.items() for f, v in zip(names, row, strict=True)], "ric string, factor_id string, loading double")
    fits = of([(k, "insufficient_history" if k == "s" else "ok", None, v) for k, v in SPECIFIC.items()], "ric string, fit_status string, use_status string, specific_variance double")
    positions = of(HELD, "account string, ric string, quantity long")
    rows = B.position_rows(positions, fits, of(list(PRICES.items()), "ric string, price double"))
    each, idio = B.parts(rows, loads), B.specific(rows)
    metrics = B.factor_metrics(B.book_loadings(each), cov, idio)
    return {"positions": positions, "rows": rows, "parts": each, "idio": idio, "metrics": metrics, "factors": of(FACTORS, "factor_id string, family string, place int"), "cov": cov, "loads": loads, "fits": fits}


def book(account):
    """Weights, loadings, covariance with the book and specific parts of an account, in numpy."""
    worth = {k: q * PRICES[k] for a, k, q in HELD if a == account and k in ("a", "b", "c")}
    gross = sum(map(abs, worth.values()))
    weight = {k: v / gross for k, v in worth.items()}
    beta = sum(w * np.array(LOADS[k]) for k, w in weight.items())
    return weight, beta, SIGMA @ beta, {k: w * w * SPECIFIC[k] for k, w in weight.items() if SPECIFIC[k]}


def test_position_rows(tables):
    got = {(r.account, r.ric): (r.coverage, r.weight) for r in tables["rows"].collect()}
    weight = book("x")[0]
    assert len(got) == len(HELD)
    for k in "abc":
        assert got["x", k] == ("covered", pytest.approx(weight[k]))
    assert got["x", "n"] == got["x", None] == got["z", "n"] == ("missing_cpar_fit", None)
    assert got["y", "s"] == ("insufficient_history", None) and got["y", "a"] == ("covered", -1.0)
    assert got[None, "a"] == ("covered", None)


def test_metrics_and_shares(tables):
    found = {}
    for r in tables["metrics"].collect():
        found.setdefault(r.account, {})[r.factor_id] = r
    assert set(found) == {"x", "y"}
    for account, rows in found.items():
        _, beta, adjustment, idio = book(account)
        total = beta @ adjustment + sum(idio.values())
        for i, (f, *_) in enumerate(FACTORS):
            if abs(beta[i]) > 1e-12:
                r = rows[f]
                assert [r.loading, r.volatility, r.adjustment, r.contribution, r.share, r.total] == pytest.approx([beta[i], SIGMA[i, i] ** 0.5, adjustment[i], beta[i] * adjustment[i], beta[i] * adjustment[i] / total, total])
            else:
                assert f not in rows
    r = {r.account: r for r in B.risk_shares(tables["metrics"], tables["idio"], tables["factors"]).collect()}["x"]
    _, beta, adjustment, idio = book("x")
    total = beta @ adjustment + sum(idio.values())
    part = beta * adjustment / total * 100
    assert [r.market, r.industry, r.style, r.idio] == pytest.approx([part[0], part[1] + part[2], part[3], sum(idio.values()) / total * 100])
    r = {r.account: r for r in B.vol_scaled_shares(tables["metrics"], tables["idio"], tables["factors"]).collect()}["x"]
    scaled = [*np.abs(beta * np.sqrt(np.diag(SIGMA))), sum(idio.values()) ** 0.5]
    assert [r.market, r.industry, r.style, r.idio] == pytest.approx([100 * v / sum(scaled) for v in (scaled[0], scaled[1] + scaled[2], scaled[3], scaled[4])], abs=0.006)


def test_chart_drilldown_and_mix(tables):
    weight, beta, adjustment, idio = book("x")
    total = beta @ adjustment + sum(idio.values())
    chart = {r.factor_id: r for r in B.chart(tables["parts"], tables["metrics"], tables["factors"]).where("account = 'x'").collect()}
    drill = {(r.factor_id, r.ric): r for r in B.drilldown(tables["parts"], tables["metrics"]).where("account = 'x'").collect()}
    mix = {r.ric: r for r in B.risk_mix(tables["parts"], tables["metrics"], tables["idio"], tables["factors"]).where("account = 'x'").collect()}
    assert set(mix) == {"a", "b", "c"}
    for i, (f, family, place) in enumerate(FACTORS):
        each = {k: w * LOADS[k][i] for k, w in weight.items() if LOADS[k][i]}
        r = chart[f]
        assert (r.family, r.place, r.n) == (family, place, len(each))
        assert [r.loading, r.long_part, r.short_part, r.sensitivity] == pytest.approx([sum(each.values()), sum(v for v in each.values() if v > 0), sum(v for v in each.values() if v < 0), beta[i] * SIGMA[i, i] ** 0.5])
        assert {k for g, k in drill if g == f} == set(each)
        for k, v in each.items():
            assert [drill[f, k].part, drill[f, k].loading, drill[f, k].risk_percent] == pytest.approx([v, LOADS[k][i], v * adjustment[i] / total * 100])
    for k, w in weight.items():
        size = np.abs(w * np.array(LOADS[k]) * adjustment)
        whole = size.sum() + idio.get(k, 0.0)
        assert [mix[k].market, mix[k].industry, mix[k].style, mix[k].idio] == pytest.approx([100 * v / whole for v in (size[0], size[1] + size[2], size[3], idio.get(k, 0.0))])


def test_cancelled_loadings_stay_in_the_chart(spark, tables):
    rows = spark.createDataFrame([("q", "a", 0.5, "V", 0.1), ("q", "b", 0.5, "V", -0.1)], "account string, ric string, weight double, factor_id string, part double")
    r = B.chart(rows, tables["metrics"].where("false"), tables["factors"]).collect()
    assert [(x.factor_id, x.loading, x.long_part, x.short_part, x.n, x.share) for x in r] == [("V", 0.0, 0.1, -0.1, 2, 0.0)]


def test_missing_covariances_raise(tables):
    lacking = tables["cov"].where("not (factor_id = 'T' and factor_id_2 = 'V')")
    with pytest.raises(Exception, match="covariance lacks pairs of T"):
        B.factor_metrics(B.book_loadings(tables["parts"]), lacking, tables["idio"]).collect()


def test_snapshots(spark, tables):
    accounts = spark.createDataFrame([("x",), ("y",), ("z",), ("e",)], "account string")
    got = {r.account: r for r in B.snapshots(tables["rows"], tables["metrics"], tables["idio"], accounts).collect()}
    assert {a: (r.status, r.reason, r.n, r.covered_n, r.excluded_n) for a, r in got.items()} == {"x": ("partial", "some_excluded", 5, 3, 2), "y": ("partial", "some_excluded", 2, 1, 1), "z": ("unavailable", "nothing_covered", 1, 0, 1), "e": ("empty", "no_positions", 0, 0, 0)}
    assert got["e"].coverage_ratio is None and got["z"].coverage_ratio == 0.0
    _, beta, adjustment, idio = book("x")
    assert [got["x"].factor_variance, got["x"].idio_variance, got["x"].gross, got["x"].net] == pytest.approx([beta @ adjustment, sum(idio.values()), 454.0, 127.0])
    assert sorted((r.account, r.ric, r.quantity) for r in B.all_accounts(tables["positions"]).collect()) == [("all_accounts", "a", 8), ("all_accounts", "b", -5), ("all_accounts", "c", 7), ("all_accounts", "n", 4), ("all_accounts", "s", 6)]


def test_hedges(spark, tables):
    """Blocked fits have no legs; two sectors that move together keep the larger loading; a short position has the legs' other sign."""
    legs, previews = B.hedges(tables["loads"], tables["cov"], "M", tables["fits"])
    found = {(r.ric, r.mode, r.factor_id): r.weight for r in legs.collect()}
    assert not any(k == "s" for k, *_ in found)
    assert {f: w for (k, m, f), w in found.items() if (k, m) == ("a", "factor_neutral")} == {"M": -1.0, "T": -0.5, "V": 0.2}
    heads = {(r.ric, r.mode): r for r in previews.collect()}
    assert len(heads) == 8
    assert (heads["s", "factor_neutral"].status, heads["s", "factor_neutral"].reason, heads["s", "factor_neutral"].reduction) == ("hedge_unavailable", "fit_status_insufficient_history", None)
    for k in LOADS:
        before = np.array(LOADS[k])
        for mode in ("market_neutral", "factor_neutral"):
            leg = np.array([found.get((k, mode, f), 0.0) for f, *_ in FACTORS])
            r = heads[k, mode]
            assert [r.gross, r.net, r.variance_before, r.variance_after] == pytest.approx([abs(leg).sum(), leg.sum(), before @ SIGMA @ before, (before + leg) @ SIGMA @ (before + leg)])
    close = np.array(SIGMA)
    close[1, 2] = close[2, 1] = 0.99 * (0.09 * 0.05) ** 0.5
    names = [f for f, *_ in FACTORS]
    cov = spark.createDataFrame([(f, g, float(close[i, j])) for i, f in enumerate(names) for j, g in enumerate(names)], "factor_id string, factor_id_2 string, covariance double")
    legs, _ = B.hedges(tables["loads"].where("ric = 'c'"), cov, "M", tables["fits"])
    assert {r.factor_id: r.weight for r in legs.where("mode = 'factor_neutral'").collect()} == {"M": -1.2, "T": 0.5, "V": -0.4}
    legs, _ = B.hedges(tables["loads"], tables["cov"], "M", tables["fits"])
    trades = {(r.account, r.ric, r.mode, r.factor_id): (r.notional, r.trade_quantity) for r in B.position_trades(tables["rows"], legs, spark.createDataFrame([("M", 50.0), ("T", 0.0)], "factor_id string, price double")).collect()}
    assert trades["x", "b", "market_neutral", "M"] == (pytest.approx(120.0), pytest.approx(2.4))
    assert trades["x", "a", "factor_neutral", "T"] == (pytest.approx(-100.0), None)


def test_security_details(spark, tables):
    registry = spark.createDataFrame([("a", "Alpha"), ("r", None)], "ric string, display_name string")
    got = {r.ric: tuple(r)[1:] for r in B.security_details(tables["fits"], spark.createDataFrame([("a", 20.0)], "ric string, price double"), registry, tables["loads"]).collect()}
    assert got["a"] == ("Alpha", "active_package", "estimated", 20.0, 3, True)
    assert got["r"] == ("r", "registry", "registry_only", None, 0, False)
    assert got["s"] == ("s", "active_package", "not_estimated", None, 4, True)


def test_empty_books(tables):
    none = tables["rows"].where("false")
    each, idio = B.parts(none, tables["loads"]), B.specific(none)
    metrics = B.factor_metrics(B.book_loadings(each), tables["cov"], idio)
    for df in (metrics, B.chart(each, metrics, tables["factors"]), B.risk_shares(metrics, idio, tables["factors"]), B.risk_mix(each, metrics, idio, tables["factors"]), B.snapshots(none, metrics, idio)):
        assert df.collect() == []
