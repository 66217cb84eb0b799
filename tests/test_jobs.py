"""Jobs that are stopped and go on, run twice, meet another method, or lose a table of a date."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import crosssection as X
from factorloom.operators import jobs as J
from factorloom.sources import commits as C

SETTINGS = {"method": "1", "winsor": 0.01, "least": 30, "styles": ["Size", "Beta"], "controls": {"Beta": ["industry"]}}
TABLES = ["factor_returns", "residuals", "eligibility"]


@pytest.fixture(scope="module")
def sections(spark):
    rng = np.random.default_rng(4)
    frames = []
    for i, n in enumerate((10, 60, 50, 45, 8)):
        day = pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)
        frames.append(pd.DataFrame({"date": day.date(), "ric": [f"r{k:02}" for k in range(n)], "ret": rng.normal(0, 0.02, n), "cap": rng.uniform(1, 100, n), "industry": rng.choice(["a", "b"], n), "core": True, "Size": rng.normal(size=n), "Beta": rng.normal(size=n)}))
    path = "sections"
    df = spark.createDataFrame(pd.concat(frames, ignore_index=True))
    return J.stored(df, path)


def content(spark, root, version=None):
    return {t: sorted(tuple(x if not isinstance(x, float) else float(f"{x:.10g}") for x in r) for r in J.table(spark, root, t, version).collect()) for t in TABLES}


def test_stopped_and_run_again(spark, sections, tmp_path, monkeypatch):
    whole, root = str(tmp_path / "whole"), str(tmp_path / "stopped")
    assert J.daily_returns_job(sections, whole, SETTINGS) == 1
    expected = content(spark, whole)
    assert {r[0].day for r in expected["eligibility"]} == {2, 3, 4, 5} and {r[0].day for r in expected["factor_returns"]} == {2, 3, 4}
    assert J.daily_returns_job(sections, whole, SETTINGS) == 1 and content(spark, whole) == expected  # nothing to do

    put, calls = C.commit, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return put(*args)

    monkeypatch.setattr(C, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        J.daily_returns_job(sections, root, SETTINGS, batch=2)
    assert J.dates_in(C.commit_of(spark, root), TABLES) == {"2024-01-02", "2024-01-03"}
    first = C.commit_of(spark, root)["parts"]
    monkeypatch.setattr(C, "commit", put)
    assert J.daily_returns_job(sections, root, SETTINGS, batch=2) == 2 and content(spark, root) == expected
    assert all(C.commit_of(spark, root)["parts"][label] == part for label, part in first.items())


def test_other_method_and_lost_table(spark, sections, tmp_path):
    root = str(tmp_path / "t")
    J.daily_returns_job(sections, root, SETTINGS)
    expected = content(spark, root)
    old = C.versions(spark, root)[-1]
    # A table of a part goes: its dates are computed again, those that share other tables' parts stay.
    before = C.commit_of(spark, root)
    lost = sorted(p for p in before["parts"] if p.startswith("residuals"))[0]
    C.commit(spark, root, old + 1, {k: v for k, v in before["parts"].items() if k != lost}, before["meta"])
    J.daily_returns_job(sections, root, SETTINGS)
    assert content(spark, root) == expected
    # Another method computes all dates; readers of the old version still have theirs.
    other = SETTINGS | {"winsor": 0.2}
    J.daily_returns_job(sections, root, other)
    assert content(spark, root)["factor_returns"] != expected["factor_returns"] and content(spark, root, old) == expected
    assert J.dates_in(C.commit_of(spark, root), TABLES) == {f"2024-01-0{i}" for i in (2, 3, 4, 5)}


def test_no_date_at_all(spark, sections, tmp_path):
    """Where no date has enough rows the tables are there, empty, and a second run has nothing to do."""
    root = str(tmp_path / "none")
    for _ in range(2):
        assert J.daily_returns_job(sections, root, SETTINGS | {"least": 1000}) == 1
    assert content(spark, root) == {t: [] for t in TABLES}


def test_history_has_fourteen_styles(spark, sections, tmp_path):
    raw = sections.withColumnsRenamed({"Size": "size_raw", "Beta": "beta_raw"}).withColumns({"turnover_1m_raw": F.col("ret") * 2, "turnover_12m_raw": F.abs("ret"), "roe_raw": F.col("cap")})
    root = str(tmp_path / "h")
    J.history_job(raw, root, {"method": "1"}, batch=3)
    out = J.table(spark, root, "sections").toPandas()
    assert len(out) == sections.count() and set(X.STYLES) <= set(out.columns) and len(C.versions(spark, root)) == 2
    day = out[out["date"] == out["date"].unique()[1]]
    assert day["Size"].std() > 0.5 and day["Liquidity"].std() > 0.5 and (day["Growth"] == 0).all()
