"""Tables in versions: numbered commit files that are created only if absent, data files that are never changed, and keyed merges
that rewrite only the buckets in which a row changes.

Below a root, `log` has one JSON file a version and `data` one folder a write. A commit names the parts that make up the
version: label -> folder, and what is known of it. Writers put their data first and then try to create the next number; one
that comes second finds the number taken, reads what the other did and tries again. Readers see whole versions only, and may
stay with one. The driver holds a commit (one entry a part), never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import stored

#: Commits that a writer tries at most.
ATTEMPTS = 50
#: Rows that a task of a merge writes, about; larger buckets are written by several tasks.
ROWS_OF_TASK = 250_000


class Conflict(RuntimeError):
    """Other writers took every number that was tried."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with the text in one step; False if there is one already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the file
            name = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(name(target), name(temp))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(temp, target, none)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(temp, False)
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that can be read, rising."""
    return sorted(_numbers(spark, root, ".json") - _numbers(spark, root, ".gone"))


def _numbers(spark: SparkSession, root: str, ending: str) -> set[int]:
    fs, log = _fs(spark, f"{root}/log")
    if not fs.exists(log):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return {int(n.removesuffix(ending)) for n in names if n.endswith(ending) and not n.startswith(".")}


def commit_of(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The commit of a version, the last one by default: version, parts and meta; version 0 without parts if there is none."""
    if version is None:
        there = versions(spark, root)
        if not there:
            return {"version": 0, "parts": {}, "meta": {}}
        version = there[-1]
    fs, path = _fs(spark, f"{root}/log/{version:020d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, version: int, parts: dict, meta: dict) -> bool:
    return put_if_absent(spark, f"{root}/log/{version:020d}.json", json.dumps({"version": version, "parts": parts, "meta": meta}, sort_keys=True))


def committed(spark: SparkSession, root: str, change: Callable[[dict], tuple[dict, dict] | None], attempts: int = ATTEMPTS) -> int:
    """Commit what change makes of the last commit (parts and meta, or None for no change), again and again while others are first; the version."""
    for _ in range(attempts):
        before = commit_of(spark, root)
        after = change(before)
        if after is None:
            return before["version"]
        if commit(spark, root, before["version"] + 1, *after):
            return before["version"] + 1
    raise Conflict(root)


def read(spark: SparkSession, root: str, version: int | None = None, labels: list[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its parts."""
    parts = commit_of(spark, root, version)["parts"]
    return spark.read.parquet(*[f"{root}/{p['path']}" for label, p in sorted(parts.items()) if labels is None or label in labels])


def publish(rows: DataFrame, root: str, meta: dict | None = None) -> int:
    """Rows as the whole next version."""
    path = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{path}")
    return committed(rows.sparkSession, root, lambda before: ({"all": {"path": path}}, meta or {}))


def prune(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Give up all but the last `keep` versions, and delete data that only they have; their numbers, which stay taken."""
    there = versions(spark, root)
    gone, kept = there[:-keep], there[-keep:]
    paths = lambda numbers: {p["path"] for n in numbers for p in commit_of(spark, root, n)["parts"].values()}
    lost = paths(gone) - paths(kept)
    for number in gone:
        put_if_absent(spark, f"{root}/log/{number:020d}.gone", "")
    for path in lost:
        fs, where = _fs(spark, f"{root}/{path}")
        fs.delete(where, True)
    return gone


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))


def merge(rows: DataFrame, root: str, keys: list[str], *, gone: DataFrame | None = None, buckets: int = 64, attempts: int = ATTEMPTS) -> int:
    """Rows replace those of their key in a table, keys of `gone` leave it; the version, the old one if nothing is different.

    The table's parts are buckets by hash of the key, as many as at first. Buckets in which no row changes keep their files; a bucket of which
    a row does is read, merged and written as a new part, with how many rows it has and its least and greatest keys. rows has each key once.
    """
    spark = rows.sparkSession
    key = F.struct(*keys)

    def change(before: dict) -> tuple[dict, dict] | None:
        parts, count = before["parts"], before["meta"].get("buckets", buckets)
        if before["version"] and "buckets" not in before["meta"]:
            raise ValueError(f"{root} has no buckets")
        staged = stored(rows.withColumn("_bucket", bucket_of(keys, count)), "merge")
        if not staged.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key has several rows")
        leaving = None if gone is None else stored(gone.select(*keys).distinct().withColumn("_bucket", bucket_of(keys, count)), "merge")
        named = [r["_bucket"] for r in (staged if leaving is None else staged.select("_bucket").unionByName(leaving.select("_bucket"))).select("_bucket").distinct().collect()]
        touched = [b for b in named if b in parts]
        others = [c for c in rows.columns if c not in keys]
        news = staged.select(key.alias("_key"), F.struct(*others).alias("_new"), "_bucket") if others else staged.select(key.alias("_key"), F.struct(F.lit(1)).alias("_new"), "_bucket")
        if touched:
            old = read(spark, root, before["version"], touched).select(*rows.columns)
            olds = old.select(key.alias("_key"), (F.struct(*others) if others else F.struct(F.lit(1))).alias("_old"))
            met = news.join(olds, "_key", "left")
            different = met.where(F.col("_old").isNull() | ~F.col("_new").eqNullSafe(F.col("_old"))).select("_bucket")
            if leaving is not None:
                different = different.unionByName(leaving.join(old.select(*keys), keys, "left_semi").select("_bucket"))
        else:
            old, different = None, news.select("_bucket")
        changed = sorted(r["_bucket"] for r in different.distinct().collect())
        if not changed:
            return None
        after = staged.where(F.col("_bucket").isin(changed))
        here = [b for b in changed if b in parts]
        if here:
            old = read(spark, root, before["version"], here).select(*rows.columns)
            stay = old.join(staged.select(*keys), keys, "left_anti")
            stay = stay if leaving is None else stay.join(leaving.select(*keys), keys, "left_anti")
            after = after.unionByName(stay.withColumn("_bucket", bucket_of(keys, count)))
        path = f"data/{uuid.uuid4().hex}"
        size = staged.count() + sum(parts[b]["rows"] for b in here)
        pieces = max(1, -(-size // (ROWS_OF_TASK * len(changed))))
        after.repartition(len(changed) * pieces, "_bucket", F.pmod(F.hash(*keys), F.lit(pieces))).write.partitionBy("_bucket").parquet(f"{root}/{path}")
        stats = spark.read.parquet(f"{root}/{path}").groupBy("_bucket").agg(F.count("*").alias("n"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high")).collect()
        found = {r["_bucket"]: {"path": f"{path}/_bucket={r['_bucket']}", "rows": r["n"], "low": r["low"], "high": r["high"]} for r in stats}
        return {b: p for b, p in parts.items() if b not in changed} | found, before["meta"] | {"buckets": count, "keys": keys}

    return committed(spark, root, change, attempts)


def sync(source: DataFrame, root: str, keys: list[str], *, mode: str, date: str | None = None, overlap_days: int = 0, buckets: int = 64) -> int:
    """Bring a bucketed table up to source: mode upsert merges its keys, full also drops keys it lacks, and incremental reads only dates from the
    table's last one less the overlap on, where it drops what source lacks, and what source has of a key before the table's first date of it.

    keys hold the date; the first of them is the key that is filled back.
    """
    spark = source.sparkSession
    if mode == "upsert" or not versions(spark, root):
        return merge(source, root, keys, buckets=buckets)
    table = read(spark, root)
    if mode == "full":
        return merge(source, root, keys, gone=table.join(source.select(*keys), keys, "left_anti"), buckets=buckets)
    if mode != "incremental" or not date:
        raise ValueError("mode is full, incremental (with a date) or upsert")
    cut = table.agg(F.date_sub(F.max(date), overlap_days).alias("c")).first()["c"]
    first = lambda df, name: df.groupBy(F.col(keys[0]).alias("_key")).agg(F.min(date).alias(name))
    late = first(source, "_s").join(first(table, "_t"), "_key").where(F.col("_s") < F.col("_t"))
    back = source.join(late, F.col(keys[0]) == F.col("_key")).where((F.col(date) < F.col("_t")) & (F.col(date) < F.lit(cut))).select(*source.columns)
    recent = source.where(F.col(date) >= F.lit(cut))
    gone = table.where(F.col(date) >= F.lit(cut)).join(recent.select(*keys), keys, "left_anti")
    return merge(recent.unionByName(back), root, keys, gone=gone, buckets=buckets)


def cached(root: str, signature: DataFrame, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table at root and whether it was made now: it is made again only if the signature (one value) isn't that of its commit."""
    spark, now = signature.sparkSession, str(signature.first()[0])
    if commit_of(spark, root)["meta"].get("signature") == now:
        return read(spark, root), False
    publish(make(), root, {"signature": now})
    return read(spark, root), True
