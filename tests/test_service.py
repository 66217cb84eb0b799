"""Service operators on small fixtures."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import riskmodel as M
from factorloom.operators import service as V

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_turnover(spark):
    """Keys of either date count with all factors; a day's change is divided by the days between; one date gives nothing."""
    rows = [(day(0), "a", "F", 1.0), (day(0), "b", "G", 2.0), (day(2), "a", "F", 3.0), (day(3), "a", "F", 3.0)]
    df = spark.createDataFrame(rows, "date date, ric string, factor_name string, exposure double")
    out = {r.date: (r.raw_turnover, r.turnover, r.roll60, r.interval_days) for r in V.exposure_turnover(df, "date", "ric").collect()}
    assert out == {day(2): (1.0, 0.5, 0.5, 2), day(3): (0.0, 0.0, 0.0, 1)}
    assert V.exposure_turnover(df.where("date = '2024-01-01'"), "date", "ric").count() == 0
    assert V.exposure_turnover(df.limit(0), "date", "ric").count() == 0


def test_block_r2(spark):
    """All that styles explain is the increment; without spread every share is 0."""
    rows = [(DAY, 1.0, 4.0, 0.0, 1.0), (DAY, -1.0, 4.0, 0.0, -1.0), (day(1), 0.5, 4.0, 0.0, None), (day(1), 0.5, 4.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "date date, ret double, cap double, e double, s double")
    out = {r.date: (r.full_r2, r.structural_r2, r.incremental_r2) for r in V.block_r2(df, "date", "ret", "cap", "e", "s").collect()}
    assert out == {DAY: (1.0, 0.0, 1.0), day(1): (0.0, 0.0, 0.0)}


def test_search_order(spark):
    """Tickers go before rics and names, the package before the registry; registry rows that the package has don't come twice."""
    schema = "ric string, ticker string, display_name string"
    package = spark.createDataFrame([("A.N", "A", "Alpha"), ("X.N", "XA", None)], schema)
    registry = spark.createDataFrame([("A.N", "A", "Alpha"), ("A.P", "A", "Alpha"), ("Q.N", "Q", "Gamma"), ("Z.N", "Z", "Z")], schema)
    got = [(r.ric, r.source_order) for r in V.search(package, registry, "a", 10).collect()]
    assert got == [("A.N", 0), ("A.P", 1), ("X.N", 0), ("Q.N", 1)]
    assert V.search(package, registry, "a", 1).collect()[0].ric == "A.N"


def test_scopes(spark):
    flags = ["price_enabled", "pit_enabled", "equity", "classified", "projection", "core", "extended", "degraded"]
    schema = "ric string, ticker string, tracking string, exchange string, source string, " + ", ".join(f"{c} int" for c in flags)
    rows = [("b.P", "B", None, None, None, 1, 1, 1, 1, 0, 0, 0, 0), ("b.N", "B", "active", None, "x", 1, 1, 1, 1, 0, 0, 0, 0), ("c.N", "C", "disabled", None, "x", 1, 1, 1, 1, 1, 1, 1, 0), ("d.N", "D", "", None, "m_seed", 1, 0, 0, 0, None, 0, 1, 0), ("e.N", " ", None, None, "x", 1, 1, 1, 1, 1, 1, 1, 0)]
    df = spark.createDataFrame(rows, schema)
    names = lambda s: sorted(r.ric for r in V.scope(df, s).collect())
    assert names("identifier_refresh") == ["B.N", "B.P", "D.N"]
    assert names("pit_ingest") == ["B.N", "D.N"] and names("weekly_build") == ["D.N"] and names("returns_projection") == []
    with pytest.raises(ValueError, match="unknown scope"):
        V.scope(df, "other")


@pytest.mark.parametrize("held,missing,ok", [(100, 0, True), (10, 5, True), (1000, 25, True), (100, 6, False), (10_000, 26, False)])
def test_membership_coverage(spark, held, missing, ok):
    served = spark.range(held + missing).select(F.lit("u").alias("by"), F.col("id").cast("string").alias("ric"))
    (row,) = V.membership_coverage(served, served.where(F.col("ric").cast("int") < held), "by", "ric").collect()
    assert (row.matched, row.missing, row.ok) == (held, missing, ok)


def test_universe_loadings(spark):
    """Native exposures go before projected ones; keys without either are ineligible."""
    rows = lambda *r: spark.createDataFrame(r, "ric string, factor_name string, exposure double")
    cov = spark.createDataFrame([("M", "M", 0.04), ("M", "S", 0.01), ("S", "S", 0.09)], "factor_name string, factor_name_2 string, covariance double")
    scope = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "ric string")
    out = {r.ric: (r.risk_loading, r.model_status, r.exposure_origin) for r in V.universe_loadings(rows(("a", "M", 1.0), ("a", "S", -1.0)), cov, rows(("a", "M", 9.0), ("b", "M", 0.5)), scope).collect()}
    assert out == {"a": (0.5, "core_estimated", "native"), "b": (0.1, "projected_only", "projected"), "c": (None, "ineligible", None)}


def test_weekly_positions(spark):
    """Weights are of covered gross value; parts come largest first."""
    held = spark.createDataFrame([("p", "a", 30.0, True), ("p", "b", -10.0, True), ("p", "c", 99.0, False), ("p", "d", None, True)], "account string, ric string, market_value double, covered boolean")
    loads = spark.createDataFrame([("a", "M", 1.0), ("a", "S", -2.0), ("b", "M", 0.0), ("c", "M", 1.0)], "ric string, factor_id string, loading double")
    rows = V.weekly_positions(held, loads)
    got = {r.ric: (r.weight, r.contributions and [tuple(c) for c in r.contributions]) for r in rows.collect()}
    assert got == {"a": (0.75, [("S", -1.5), ("M", 0.75)]), "b": (-0.25, None)}
    assert {(r.factor_id, r.loading, r.n) for r in V.aggregate_loadings(rows).collect()} == {("M", 0.75, 1), ("S", -1.5, 1)}


def test_staged_rows_keep_their_place(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "n int, s string")
    one = {(r.name, r.place): r.payload for r in V.staged({"p": df}, "s1").collect()}
    assert set(one) == {(r.name, r.place) for r in V.staged({"p": df}, "s2").collect()} and '{"n":1,"s":null}' in one.values()


def test_eigenvalues(spark):
    rng = np.random.default_rng(3)
    matrices = {"u": rng.normal(size=(3, 3)), "v": rng.normal(size=(2, 2))}
    matrices = {k: m @ m.T for k, m in matrices.items()}
    cells = [(k, f"F{i}", f"F{j}", float(m[i, j])) for k, m in matrices.items() for i in range(len(m)) for j in range(len(m))]
    out = M.eigenvalues(spark.createDataFrame(cells, "model string, factor_name string, factor_name_2 string, covariance double")).orderBy("model", "place").collect()
    for k, m in matrices.items():
        assert np.allclose([r.eigenvalue for r in out if r.model == k], np.linalg.eigvalsh(m)[::-1])


def test_restamped(spark):
    """Stamps replace what a payload had, nulls stay, payloads without a schema aren't touched, and the same stamps give the same places."""
    first = spark.createDataFrame([("1", 2, None), ("2", 3, "run-1")], "ric string, n long, run_id string")
    rows = V.staged({"book": first, "other": first}, "s1")
    again = V.restamped(rows, {"book": "ric string, n long, run_id string"}, {"run_id": "run-2"}, "s2")
    got = {(r.name, r.payload) for r in again.collect()}
    assert got == {("book", '{"ric":"1","n":2,"run_id":"run-2"}'), ("book", '{"ric":"2","n":3,"run_id":"run-2"}'), ("other", '{"ric":"1","n":2,"run_id":null}'), ("other", '{"ric":"2","n":3,"run_id":"run-1"}')}
    assert {r.snapshot for r in again.collect()} == {"s2"} and again.select("place").exceptAll(again.select("place")).count() == 0
    assert rows.where("name = 'other'").select("place").exceptAll(again.where("name = 'other'").select("place")).count() == 0


def test_fingerprint(spark):
    """The md5 over all sorted hashes, every digit of them."""
    import hashlib

    from factorloom.operators import desk as D

    rows = [("a", "1", 5), ("a", "2", -3), ("b", "1", 5)]
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    found = {r["account"]: (r["n"], r["signature"]) for r in D.fingerprint(spark.createDataFrame(rows, "account string, ric string, quantity long"), "account", ["ric", "quantity"]).collect()}
    assert found == {a: (sum(r[0] == a for r in rows), md5(",".join(sorted(md5(f"{ric}|{q}") for b, ric, q in rows if b == a)))) for a in ("a", "b")}


def test_restamped_parses_once(spark):
    """A payload is parsed once a row, not once a field; a null one stays null."""
    rows = spark.createDataFrame([("s1", "book", "p", '{"ric":"A","n":1,"run_id":"run-1"}'), ("s1", "book", "q", None)], "snapshot string, name string, place string, payload string")
    again = V.restamped(rows, {"book": "ric string, n long, run_id string"}, {"run_id": "run-2", "stamp": "x"}, "s2")
    assert again._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.payload for r in again.orderBy("place").collect()] == [None, '{"ric":"A","n":1,"run_id":"run-2","stamp":"x"}']
