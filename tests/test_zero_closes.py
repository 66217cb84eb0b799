"""Returns over a close of zero, which SQL has as infinite or NaN, and returns whose product with 10^6 is a half."""

import duckdb
import pytest
from test_plans import TABLES, plain

from factorloom.plans import registry


@pytest.fixture(scope="module")
def zeros(small, tmp_path_factory):
    """The small tables, some closes of which are zero."""
    top = tmp_path_factory.mktemp("zeros")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        value = "SELECT * REPLACE (CASE WHEN hash(user_id, cast(ts AS DATE)) % 9 = 0 THEN 0 ELSE value END AS value)" if t == "events" else "SELECT *"
        con.execute(f"COPY ({value} FROM '{small}/{t}.parquet') TO '{top}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    return str(top), con


@pytest.mark.parametrize(
    "name",
    [
        "h22_forecast_and_realized",
        "e09b_full_coverage",
        "e13b_t_hit_rate",
        "e14_breadth",
        "e14b_t_breadth",
        "e16_correlations",
        "e26_turnover",
        "e26b_exposure_turnover",
        "f01_momentum",
        "f02_bridging_return",
        "f03_panel_return",
        "f04_rolling_std",
        "f06_rolling_beta",
        "e04_cap_weighted_market",
        "e06_weighted_moments",
        "g05_daily_factor_returns",
    ],
)
def test_against_sql(spark, zeros, name):
    top, con = zeros
    df = registry.QUERIES[name](spark, top)
    cur = con.execute(registry.ORACLES[name])
    columns = [x[0] for x in cur.description]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)


@pytest.fixture(scope="module")
def ties(small, tmp_path_factory):
    """The small tables, with closes of 19.20 / 3 and 169.61 / 5 by turns: the return is 4.3003125 less its last bit, which SQL rounds up."""
    top = tmp_path_factory.mktemp("ties")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        rows = f"'{small}/{t}.parquet'"
        if t == "events":
            days = f"(SELECT user_id, any_value(event_type) AS event_type, any_value(props) AS props FROM {rows} GROUP BY 1), range(10) d(d), range(5) n(n) WHERE d % 2 = 1 OR n < 3"
            rows = f"(SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_days(cast(d AS INTEGER)) AS ts, user_id, event_type, CASE WHEN n > 0 THEN 0e0 WHEN d % 2 = 1 THEN 169.61e0 ELSE 19.2e0 END AS value, props FROM {days})"
        con.execute(f"COPY (SELECT * FROM {rows}) TO '{top}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    return str(top), con


@pytest.mark.parametrize("name", ["f02_bridging_return", "f03_panel_return", "e03_median_return"])
def test_ties(spark, ties, name):
    test_against_sql(spark, ties, name)


@pytest.fixture(scope="module")
def one_zero(small, tmp_path_factory):
    """The small tables, where one security of the panel has a close of zero, so that only its industry and the market have an infinite return."""
    top = tmp_path_factory.mktemp("one")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        value = "SELECT * REPLACE (CASE WHEN user_id = 3 AND cast(ts AS DATE) = DATE '2024-01-12' THEN 0 ELSE value END AS value)" if t == "events" else "SELECT *"
        con.execute(f"COPY ({value} FROM '{small}/{t}.parquet') TO '{top}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    return str(top), con


@pytest.mark.parametrize("name", ["g04_orthogonal_styles", "g09_factor_covariance", "g21b_eigenvalue_sums"])
def test_one_zero(spark, one_zero, name):
    test_against_sql(spark, one_zero, name)
