"""Queries for audits of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as Q
from ..sources import adapters as A
from .catalog import query


@query("j01_parity_issues", ", l AS (SELECT * FROM prices), r AS (SELECT ric, date, CASE WHEN volume = 2 THEN NULL ELSE close END AS close, volume FROM prices WHERE volume <> 3), pl AS (SELECT count(*) AS row_n, min(date) AS first, max(date) AS last, count(close) AS close_n, (SELECT count(DISTINCT ric) FROM l WHERE date = (SELECT max(date) FROM l)) AS last_ids FROM l), pr AS (SELECT count(*) AS row_n, min(date) AS first, max(date) AS last, count(close) AS close_n, (SELECT count(DISTINCT ric) FROM r WHERE date = (SELECT max(date) FROM r)) AS last_ids FROM r), x AS (SELECT 'row_n' AS issue, cast(pl.row_n AS VARCHAR) AS left_value, cast(pr.row_n AS VARCHAR) AS right_value FROM pl, pr UNION ALL SELECT 'first', cast(pl.first AS VARCHAR), cast(pr.first AS VARCHAR) FROM pl, pr UNION ALL SELECT 'last', cast(pl.last AS VARCHAR), cast(pr.last AS VARCHAR) FROM pl, pr UNION ALL SELECT 'last_ids', cast(pl.last_ids AS VARCHAR), cast(pr.last_ids AS VARCHAR) FROM pl, pr UNION ALL SELECT 'close_n', cast(pl.close_n AS VARCHAR), cast(pr.close_n AS VARCHAR) FROM pl, pr) SELECT * FROM x WHERE left_value IS DISTINCT FROM right_value")
def j01(spark, d):
    left = A.prices(spark, d)
    right = left.where("volume <> 3").withColumn("close", F.when(F.col("volume") != 2, F.col("close")))
    return Q.parity_issues(left, right, "ric", "date", ["close"])


@query("j04_duplicate_keys", "SELECT ric, as_of_date, count(*) AS n FROM fundamentals GROUP BY 1, 2 HAVING count(*) > 1")
def j04(spark, d):
    return Q.duplicate_keys(A.fundamentals(spark, d), ["ric", "as_of_date"])


@query("j05_period_health", "SELECT ric, cast(date_trunc('month', as_of_date) AS DATE) AS period, count(DISTINCT as_of_date) AS anchors FROM fundamentals GROUP BY 1, 2 HAVING count(DISTINCT as_of_date) > 1")
def j05(spark, d):
    return Q.crowded_periods(A.fundamentals(spark, d), "ric", "as_of_date")


@query("j06_source_observations", ", p AS (SELECT ric, max(date) AS latest_price FROM prices GROUP BY 1), f AS (SELECT ric, max(as_of_date) AS latest_fundamentals FROM fundamentals GROUP BY 1) SELECT ric, latest_price, latest_price IS NOT NULL AS has_price, latest_fundamentals, latest_fundamentals IS NOT NULL AS has_fundamentals, latest_price IS NOT NULL AND latest_fundamentals IS NOT NULL AS ready FROM registry LEFT JOIN p USING (ric) LEFT JOIN f USING (ric)")
def j06(spark, d):
    return Q.observations(A.registry(spark, d).select("ric"), {"price": A.prices(spark, d).select("ric", "date"), "fundamentals": A.fundamentals(spark, d).select("ric", F.col("as_of_date").alias("date"))})
