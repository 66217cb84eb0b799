"""Queries for loads and sinks; what they write is read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk as D
from ..operators import relational as R
from ..sources import adapters as A
from ..sources import commits as C
from ..sources import sinks as K
from .catalog import query


def yearly(spark, d):
    """(ric, year, n, cap): fundamentals by security and year."""
    return A.fundamentals(spark, d).groupBy("ric", F.year("as_of_date").alias("year")).agg(F.count("*").alias("n"), F.max("market_cap").alias("cap"))


YEARLY = ", yr AS (SELECT ric, year(as_of_date) AS year, count(*) AS n, max(market_cap) AS cap FROM fundamentals GROUP BY 1, 2)"


@query("a03_picked_column", " SELECT ric, coalesce(sector, country) AS label FROM registry")
def a03(spark, d):
    return K.picked(A.registry(spark, d), ["trbc_sector", "sector", "country"], "label").select("ric", "label")


def import_file(spark, d):
    """Rows of a holdings file made from parts: good ones, and each kind of bad one."""
    p = A.parts(spark, d)
    n = F.col("ric").cast("int")
    bad = lambda k, value, good: F.when(n % 17 == k, value).otherwise(good)
    rows = p.select(n.alias("row_number"), bad(1, "", F.concat(F.lit("acct"), (n % 5).cast("string"))).alias("account"), bad(2, "many", (n % 100).cast("string")).alias("quantity"), bad(3, "ZZZ", bad(4, "", bad(5, "", F.col("ric")))).alias("ric"), bad(4, F.concat(F.lit("t"), "ric"), bad(6, F.lit(None).cast("string"), F.lit(""))).alias("ticker"))
    return rows.unionByName(rows.where(F.col("row_number") % 50 == 7).withColumn("row_number", F.col("row_number") + 1_000_000_000))


FILE = ", f0 AS (SELECT cast(ric AS INTEGER) AS row_number, CASE WHEN cast(ric AS INTEGER) % 17 = 1 THEN '' ELSE 'acct' || (cast(ric AS INTEGER) % 5) END AS account, CASE WHEN cast(ric AS INTEGER) % 17 = 2 THEN 'many' ELSE cast(cast(ric AS INTEGER) % 100 AS VARCHAR) END AS quantity, CASE cast(ric AS INTEGER) % 17 WHEN 3 THEN 'ZZZ' WHEN 4 THEN '' WHEN 5 THEN '' ELSE ric END AS ric, CASE cast(ric AS INTEGER) % 17 WHEN 4 THEN 't' || ric WHEN 6 THEN NULL ELSE '' END AS ticker FROM parts), f1 AS (SELECT * FROM f0 UNION ALL SELECT row_number + 1000000000, account, quantity, ric, ticker FROM f0 WHERE row_number % 50 = 7), m AS (SELECT f1.row_number, f1.account, try_cast(f1.quantity AS DOUBLE) AS qty, f1.ric AS g, coalesce(f1.ticker, '') AS t, p.ric AS known, q.ric AS resolved FROM f1 LEFT JOIN parts p ON p.ric = f1.ric LEFT JOIN parts q ON cast(q.ric AS INTEGER) % 2 = 0 AND 'T' || q.ric = upper(f1.ticker)), r AS (SELECT *, CASE WHEN account = '' THEN 'invalid_account_id' WHEN qty IS NULL THEN 'invalid_quantity' WHEN g <> '' AND known IS NULL THEN 'unknown_ric' WHEN g = '' AND t = '' THEN 'missing_identifier' WHEN g = '' AND resolved IS NULL THEN 'unknown_ticker' END AS r0 FROM m), parsed AS (SELECT row_number, account, CASE WHEN r0 IS NULL THEN CASE WHEN g <> '' THEN g ELSE resolved END END AS ric, qty, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY account, r0 IS NULL, CASE WHEN r0 IS NULL THEN CASE WHEN g <> '' THEN g ELSE resolved END END ORDER BY row_number) > 1 THEN 'duplicate_row_in_file' ELSE r0 END AS reason FROM r)"


def parsed(spark, d):
    p = A.parts(spark, d)
    return K.parsed_holdings(import_file(spark, d), p, p.where(F.col("ric").cast("int") % 2 == 0).select(F.concat(F.lit("T"), "ric").alias("ticker"), F.col("ric").alias("resolved")))


@query("a05_holdings_import", FILE + " SELECT * FROM parsed")
def a05(spark, d):
    """The rows go out as a CSV file with a header and come back."""
    path = K.shared_folder(spark, "import")
    import_file(spark, d).write.option("header", True).option("nullValue", "").csv(path)
    p = A.parts(spark, d)
    rows = spark.read.schema("row_number int, account string, quantity string, ric string, ticker string").option("header", True).csv(path)
    rows = rows.fillna("", ["account"])
    return K.parsed_holdings(rows, p, p.where(F.col("ric").cast("int") % 2 == 0).select(F.concat(F.lit("T"), "ric").alias("ticker"), F.col("ric").alias("resolved")))


@query("a06_reject_counts", FILE + " SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM parsed GROUP BY 1")
def a06(spark, d):
    return parsed(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


SEED = ", seed AS (SELECT ric, CASE WHEN cast(ric AS INTEGER) % 3 = 0 THEN '' ELSE 'NEW' || ric END AS ticker, CASE WHEN cast(ric AS INTEGER) % 4 = 0 THEN 'EUROPE' END AS scope FROM registry WHERE cast(ric AS INTEGER) % 2 = 0 UNION ALL SELECT 'X' || ric, 'X', 'ASIA' FROM registry WHERE cast(ric AS INTEGER) % 10 = 1)"


def seed(spark, d):
    r = A.registry(spark, d)
    n = F.col("ric").cast("int")
    old = r.where(n % 2 == 0).select("ric", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("NEW"), "ric")).alias("ticker"), F.when(n % 4 == 0, "EUROPE").alias("scope"))
    return old.unionByName(r.where(n % 10 == 1).select(F.concat(F.lit("X"), "ric").alias("ric"), F.lit("X").alias("ticker"), F.lit("ASIA").alias("scope")))


@query("a07_seed_upsert", SEED + " SELECT coalesce(r.ric, s.ric) AS ric, coalesce(nullif(s.ticker, ''), r.ticker) AS ticker, coalesce(nullif(s.scope, ''), r.scope) AS scope FROM registry r FULL JOIN seed s ON r.ric = s.ric")
def a07(spark, d):
    """The seed is a CSV file; blanks keep what the registry has (A12)."""
    path = K.shared_folder(spark, "seed")
    seed(spark, d).write.option("header", True).csv(path)
    rows = spark.read.option("header", True).schema("ric string, ticker string, scope string").csv(path)
    return R.upsert_keep_old(A.registry(spark, d).select("ric", "ticker", "scope"), rows, ["ric"], ["ticker", "scope"])


@query("a09_vendor_rows", " SELECT seq, cast(as_of_date AS VARCHAR) AS iso_date, year(as_of_date) AS year, CASE WHEN seq % 2 = 0 THEN quarter(as_of_date) END AS quarter, market_cap AS value FROM fundamentals")
def a09(spark, d):
    f = A.fundamentals(spark, d)
    raw = f.select("seq", F.date_format("as_of_date", "yyyy-MM-dd").alias("Period End Date"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("FY"), F.year("as_of_date"), F.lit("q"), F.quarter("as_of_date"))).otherwise(F.year("as_of_date").cast("string")).alias("Fiscal Period"), F.when(F.col("seq") % 3 == 0, F.col("market_cap")).alias("Value"), F.col("market_cap").alias("Value_2"))
    rows = K.picked(raw.withColumn("p", K.fiscal_period(F.col("Fiscal Period"))), ["Val", "Value", "Value_2"], "value_")
    return rows.select("seq", F.to_date("Period End Date").cast("string").alias("iso_date"), "p.*", F.col("value_").alias("value"))


@query("a10_replace_by_date", YEARLY + " SELECT ric, year, n, CASE WHEN year >= 1996 THEN cap * 2 ELSE cap END AS cap FROM yr")
def a10(spark, d):
    """All years are written, the later ones again, twice."""
    path = K.shared_folder(spark, "yearly")
    K.replace_dates(yearly(spark, d), path, "year")
    for _ in range(2):
        K.replace_dates(yearly(spark, d).where("year >= 1996").withColumn("cap", F.col("cap") * 2), path, "year")
    return spark.read.parquet(path).select("ric", "year", "n", "cap")


@query("a11_keyed_sink", YEARLY + " SELECT ric, year, n, CASE WHEN year % 2 = 0 THEN -cap ELSE cap END AS cap FROM yr WHERE year <= 1995 OR year % 2 = 0")
def a11(spark, d):
    root = K.shared_folder(spark, "keyed")
    C.merge(yearly(spark, d).where("year <= 1995"), root, ["ric", "year"], buckets=8)
    for _ in range(2):  # the second time nothing is different
        C.merge(yearly(spark, d).where("year % 2 = 0").withColumn("cap", -F.col("cap")), root, ["ric", "year"])
    return C.read(spark, root)


@query("a13_idempotent_load", " SELECT ric, arg_max(market_cap, (as_of_date, seq)) AS market_cap, max(as_of_date) AS as_of_date FROM fundamentals GROUP BY 1")
def a13(spark, d):
    """A copy of all rows is loaded; the first row of each key, in order of age, is merged into the table, twice."""
    rows = A.fundamentals(spark, d)
    root = K.shared_folder(spark, "load")
    for loaded in (rows, rows.unionByName(rows)):
        once = R.latest(loaded, ["ric"], [F.desc("as_of_date"), F.desc("seq")])
        C.merge(once.select("ric", "market_cap", "as_of_date"), root, ["ric"], buckets=8)
    return C.read(spark, root)


TARGET = ", tg AS (SELECT ric, date, volume + 1 AS volume FROM long_prices WHERE date <= DATE '1997-06-30' AND NOT (cast(ric AS INTEGER) % 3 = 0 AND date < DATE '1995-01-01'))"


@query("a14_incremental_load", TARGET + ", c AS (SELECT max(date) - 30 AS cut FROM tg), late AS (SELECT s.ric, t.t FROM (SELECT ric, min(date) AS s FROM long_prices GROUP BY 1) s JOIN (SELECT ric, min(date) AS t FROM tg GROUP BY 1) t USING (ric) WHERE s.s < t.t) SELECT ric, date, volume FROM tg, c WHERE date < cut UNION ALL SELECT ric, date, volume FROM long_prices, c WHERE date >= cut UNION ALL SELECT p.ric, p.date, p.volume FROM long_prices p JOIN late USING (ric), c WHERE p.date < late.t AND p.date < cut")
def a14(spark, d):
    source = A.long_prices(spark, d).select("ric", "date", "volume")
    target = source.where("date <= '1997-06-30' and not (cast(ric as int) % 3 = 0 and date < '1995-01-01')").withColumn("volume", F.col("volume") + 1)
    root = K.shared_folder(spark, "synced")
    C.merge(target, root, ["ric", "date"], buckets=8)
    C.sync(source, root, ["ric", "date"], mode="incremental", date="date", overlap_days=30)
    return C.read(spark, root)


@query("a14b_sync_modes", TARGET + ", s AS (SELECT ric, date, volume FROM long_prices WHERE cast(ric AS INTEGER) % 2 = 0) SELECT 'full' AS mode, * FROM s UNION ALL SELECT 'upsert', tg.ric, tg.date, coalesce(s.volume, tg.volume) FROM tg LEFT JOIN s USING (ric, date) UNION ALL SELECT 'upsert', s.* FROM s ANTI JOIN tg USING (ric, date)")
def a14b(spark, d):
    """The same target brought up to a source of half of the securities, wholly and by key."""
    source = A.long_prices(spark, d).select("ric", "date", "volume")
    target = source.where("date <= '1997-06-30' and not (cast(ric as int) % 3 = 0 and date < '1995-01-01')").withColumn("volume", F.col("volume") + 1)
    out = None
    for mode in ("full", "upsert"):
        root = K.shared_folder(spark, "synced")
        C.merge(target, root, ["ric", "date"], buckets=8)
        C.sync(source.where("cast(ric as int) % 2 = 0"), root, ["ric", "date"], mode=mode)
        rows = C.read(spark, root).select(F.lit(mode).alias("mode"), "ric", "date", "volume")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a15_load_counts", YEARLY + " SELECT count(*) AS before, count(*) FILTER (WHERE year >= 1996) AS deleted, count(*) FILTER (WHERE year >= 1996) AS loaded, count(*) AS after, true AS ok FROM yr")
def a15(spark, d):
    rows = yearly(spark, d)
    later = rows.where("year >= 1996")
    return K.load_counts(rows, later, later, rows.where("year < 1996").unionByName(later))


@query("a16_persist_from_last", YEARLY + " SELECT 'same' AS method, ric, year FROM yr WHERE year > 1996 UNION ALL SELECT 'changed', ric, year FROM yr")
def a16(spark, d):
    rows = yearly(spark, d)
    saved = rows.where("year <= 1996")
    parts = [K.from_last(rows, saved, "year", old_method="v1", new_method=m).select(F.lit(name).alias("method"), "ric", "year") for name, m in (("same", "v1"), ("changed", "v2"))]
    return parts[0].unionByName(parts[1])


@query("a17_manifest", YEARLY + ", x AS (SELECT ric || '-' || year AS name, ric, year, n FROM yr), e AS (SELECT name, sha256(to_json({'ric': ric, 'year': year, 'n': n})) AS h FROM x WHERE year <> 1993), f AS (SELECT name, sha256(to_json({'ric': ric, 'year': year, 'n': CASE WHEN year = 1994 THEN n + 1 ELSE n END})) AS h FROM x WHERE year <> 1992) SELECT coalesce(e.name, f.name) AS name, coalesce(e.h, f.h) AS hash, CASE WHEN f.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'extra' WHEN e.h = f.h THEN 'same' ELSE 'changed' END AS status FROM e FULL JOIN f ON e.name = f.name")
def a17(spark, d):
    rows = yearly(spark, d).withColumn("name", F.concat_ws("-", "ric", "year"))
    expected = K.manifest(rows.where("year <> 1993"), "name", ["ric", "year", "n"])
    found = K.manifest(rows.where("year <> 1992").withColumn("n", F.col("n") + (F.col("year") == 1994).cast("int")), "name", ["ric", "year", "n"])
    hashes = expected.unionByName(found.join(expected, "name", "left_anti"))
    return K.compared_manifests(expected, found, "name").join(hashes, "name").select("name", "hash", "status")


@query("a18_payload_field", YEARLY + " SELECT ric, year, cast(n AS BIGINT) AS field FROM yr")
def a18(spark, d):
    payload = F.to_json(F.struct(F.struct("n", "cap").alias("summary"), "ric"))
    return yearly(spark, d).select("ric", "year", payload.alias("payload")).select("ric", "year", F.get_json_object("payload", "$.summary.n").cast("long").alias("field"))


@query("a19_published_snapshot", YEARLY + " SELECT ric, year, n, cap, [1] AS gone FROM yr WHERE year = 1995")
def a19(spark, d):
    """Three versions are published, the last is read, and the oldest goes."""
    root = K.shared_folder(spark, "snapshot")
    for year in (1993, 1994, 1995):
        C.publish(yearly(spark, d).where(F.col("year") == year), root)
    gone = C.prune(spark, root, keep=2)
    return C.read(spark, root).withColumn("gone", F.array(*map(F.lit, gone)))


@query("a20_retention", " SELECT count(*) AS before, count(*) FILTER (WHERE as_of_date >= DATE '1998-08-02' - 365 * 3) AS kept FROM fundamentals")
def a20(spark, d):
    """A dry run: how many rows would stay."""
    rows = A.fundamentals(spark, d)
    kept = K.retained(rows, "as_of_date", F.lit("1998-08-02").cast("date"), 3)
    return rows.agg(F.count("*").alias("before")).join(F.broadcast(kept.agg(F.count("*").alias("kept"))))


@query("a21_sessions_only", " SELECT ric, date, volume FROM long_prices WHERE date IN (SELECT as_of_date FROM fundamentals WHERE dayofweek(as_of_date) BETWEEN 1 AND 5)")
def a21(spark, d):
    calendar = A.fundamentals(spark, d).where(F.dayofweek("as_of_date").between(2, 6)).select(F.col("as_of_date").alias("date"))
    return K.sessions_only(A.long_prices(spark, d), calendar, "date").select("ric", "date", "volume")


@query("a22_latest_prices", ", l AS (SELECT ric, max(date) AS date, arg_max(volume, date) AS volume FROM long_prices GROUP BY 1) SELECT ric, date, volume, (SELECT cast(max(date) AS VARCHAR) || '|' || count(DISTINCT ric) FROM long_prices) AS signature FROM l")
def a22(spark, d):
    rows = A.long_prices(spark, d)
    return R.latest_wide(rows, ["ric"], ["date"], ["volume"]).select("ric", "date", "volume").join(F.broadcast(K.signature(rows, "ric", "date")))


@query("a22b_latest_price_cache", ", p AS (SELECT ric, date, CASE WHEN ric = '1' THEN volume + 1 ELSE volume END AS volume FROM long_prices) SELECT ric, max(date) AS date, arg_max(volume, date) AS volume, [true, false, true] AS made FROM p GROUP BY 1")
def a22b(spark, d):
    """Latest rows are made, found unchanged, and made again when a value of the source has changed that moves neither its last date nor its keys."""
    rows = A.long_prices(spark, d).select("ric", "date", "volume")
    root, made = K.shared_folder(spark, "latest"), []
    for source in (rows, rows, rows.withColumn("volume", F.when(F.col("ric") == "1", F.col("volume") + 1).otherwise(F.col("volume")))):
        table, new = C.cached(root, source.agg(D.hash_sums(["ric", "date", "volume"])), lambda source=source: R.latest_wide(source, ["ric"], ["date"], ["volume"]).select("ric", "date", "volume"))
        made.append(new)
    return table.withColumn("made", F.array(*map(F.lit, made)))


@query("a20b_retention_delete", YEARLY + " SELECT ric, year, n, cap FROM yr WHERE year >= 1995")
def a20b(spark, d):
    """Old rows leave the stored table; buckets without any keep their files."""
    root = K.shared_folder(spark, "retained")
    C.merge(yearly(spark, d), root, ["ric", "year"], buckets=8)
    table = C.read(spark, root)
    C.merge(table.limit(0), root, ["ric", "year"], gone=table.where("year < 1995"))
    return C.read(spark, root)
