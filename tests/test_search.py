"""The index against a scan, for terms that are parts of the rows and others."""

from pyspark.sql import functions as F

from factorloom.operators import relational as R
from factorloom.operators import search as T

ROWS = [("ABC.N", "Alpha Beta Company"), ("ABCD", None), ("XAB", "abc of the sea"), ("Q", "q"), (None, "Nothing ABC"), ("É.A", "Société Ünder"), ("ABC.N", "Alpha Beta Company"), ("", "")]


def test_index_equals_scan(spark):
    rows = spark.createDataFrame(ROWS, "ticker string, name string").repartition(2)
    root = T.build_index(rows, ["ticker", "name"])
    terms = {t[i : i + k] for r in ROWS for t in r if t for k in (1, 2, 3, 5) for i in range(0, len(t), 4)} | {"zzz", "ABCX", "alpha beta", "ciété"}
    for term in sorted(terms):
        found, scan = (sorted(map(str, df.collect())) for df in (T.indexed_search(spark, root, "ticker", "name", term, 100), R.ranked_search(rows, "ticker", "name", term, 100)))
        assert found == scan, term
    empty = T.build_index(rows.limit(0), ["ticker", "name"])
    assert T.indexed_search(spark, empty, "ticker", "name", "q", 5).count() == 0


def test_one_folder_is_read(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("ticker"), F.concat(F.lit("name of "), F.col("id") * 7).alias("name"))
    root = T.build_index(rows, ["ticker", "name"])
    plan = T.candidates(spark, root, "f 343")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "EqualTo(_gram," in plan
    assert {r.ticker for r in T.indexed_search(spark, root, "ticker", "name", "f 343", 10).collect()} == {"49", "490", "491"}


def test_rows_are_dealt_out(spark, monkeypatch):
    """Rows of one small file are spread before their postings are made."""
    monkeypatch.setattr(T, "ROWS_OF_TASK", 10)
    rows = spark.range(100).selectExpr("cast(id as string) AS ric", "concat('name ', id) AS name").coalesce(1)
    root = T.build_index(rows, ["ric", "name"])
    files = {r["f"].rsplit("/", 1)[1].split("-")[1] for r in spark.read.parquet(f"{root}/postings").select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 10
