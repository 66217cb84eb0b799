"""Jobs by date that can be stopped and go on: what is computed is committed in batches of dates, all tables of a batch at once.

The ledger is the log of a versioned table (sources/commits.py). A commit names, for each table, the parts and the dates in
them, and the signature of the method. A run computes the dates that any table lacks; under another signature it starts anew,
and readers keep the old tables until the first batch is there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits as C
from ..sources.sinks import stored
from . import crosssection as X

#: Dates of a batch.
BATCH = 250


def signature(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def dates_in(commit: dict, tables: list[str]) -> set[str]:
    """Dates that all tables of a commit have."""
    by_table = [{d for p in commit["parts"].values() if p["table"] == t for d in p["dates"]} for t in tables]
    return set.intersection(*by_table) if by_table else set()


def table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the ledger's last version, or of the one given; a date that was computed again has its last part."""
    parts = [p for _, p in sorted(C.commit_of(spark, root, version)["parts"].items()) if p["table"] == name]
    return spark.read.parquet(*[f"{root}/{p['path']}" for p in parts])


def resumed(spark: SparkSession, root: str, settings: dict, dates: DataFrame, tables: list[str], compute: Callable[[DataFrame], dict[str, DataFrame]], *, batch: int = BATCH) -> int:
    """Compute and commit what tables lack of dates (one column), `batch` dates at a time; the last version.

    compute takes a table of dates, and gives each table's rows of these dates. Runs that meet each other do some dates
    twice, but commit them once. Without a date to compute the tables are there, empty.
    """
    date, method = dates.columns[0], signature(settings)
    while True:
        before = C.commit_of(spark, root)
        same = before["meta"].get("signature") == method
        done = dates_in(before, tables) if same else set()
        known = spark.createDataFrame([(d,) for d in sorted(done)], "_done string")
        todo = dates.distinct().join(F.broadcast(known), F.col(date).cast("string") == F.col("_done"), "left_anti")
        now = [r[0] for r in todo.orderBy(date).limit(batch).collect()]
        if not now and same and before["parts"]:
            return before["version"]
        rows = compute(spark.createDataFrame([(d,) for d in now], dates.schema))
        if set(rows) != set(tables):
            raise ValueError(f"tables {sorted(rows)} instead of {sorted(tables)}")
        names = [str(d) for d in now]
        # Parts of these dates that a table had without the others are replaced.
        parts = {}
        for label, part in (before["parts"] if same else {}).items():
            if not set(part["dates"]) & set(names):
                parts[label] = part
            elif set(part["dates"]) - set(names):
                rest = stored(spark.read.parquet(f"{root}/{part['path']}").where(~F.col(date).cast("string").isin(names)), "rest")
                rows[part["table"]] = rows[part["table"]].unionByName(rest)
                names_of_rest = set(part["dates"]) - set(names)
                parts[f"{label}-rest"] = {"table": part["table"], "path": None, "dates": sorted(names_of_rest)}
        run = uuid.uuid4().hex
        for name in tables:
            path = f"data/{run}/{name}"
            rows[name].write.parquet(f"{root}/{path}")
            kept = [d for label in list(parts) if parts[label]["path"] is None and parts[label]["table"] == name for d in parts.pop(label)["dates"]]
            parts[f"{name}/{before['version'] + 1:09d}"] = {"table": name, "path": path, "dates": sorted({*names, *kept})}
        C.commit(spark, root, before["version"] + 1, parts, {"signature": method, "settings": settings})


def daily_tables(sections: DataFrame, settings: dict) -> dict[str, DataFrame]:
    """factor_returns, residuals and eligibility of the dates of sections (date, ric, ret, cap, industry, core, raw styles)."""
    styles, controls = settings["styles"], settings["controls"]
    rows = X.winsorized(sections.withColumn("raw", F.col("ret")), ["date"], "ret", settings["winsor"])
    rows = stored(X.scored_styles(rows, "date", styles, "cap", "industry", "core", controls), "scored")
    both = X.cross_sections(rows.where("core"), "date", "ret", "cap", "industry", styles, settings["least"])
    sums, residuals = stored(both[0], "sums"), stored(both[1], "residuals")
    some = lambda c: F.count(F.when(c, 1))
    usable = F.col("core") & F.col("ret").isNotNull() & (F.col("cap") > 0) & F.col("industry").isNotNull()
    eligibility = rows.groupBy("date").agg(F.count("*").alias("rows_n"), some(F.col("core")).alias("core_n"), some(F.col("ret").isNotNull()).alias("returns_n"), some(usable).alias("regression_n"))
    return {
        "factor_returns": X.factor_returns(rows, "date", "ret", "cap", "industry", styles, sections=(sums, residuals)),
        "residuals": residuals.select("date", "ric", "industry", "cap", "ret", "fitted", "residual", (F.col("raw") - F.col("fitted")).alias("raw_residual"), *[F.col(f"`{s}`") for s in styles]),
        "eligibility": eligibility,
    }


def daily_returns_job(sections: DataFrame, root: str, settings: dict, *, batch: int = BATCH) -> int:
    """Daily factor returns, residuals and eligibility counts from the first date with `least` usable rows on; the ledger's version."""
    usable = sections.where(F.col("core") & F.col("ret").isNotNull() & (F.col("cap") > 0) & F.col("industry").isNotNull())
    first = usable.groupBy("date").count().where(F.col("count") >= settings["least"]).agg(F.min("date").alias("_first"))
    dates = sections.select("date").distinct().join(F.broadcast(first)).where(F.col("date") >= F.col("_first")).select("date")
    compute = lambda asked: daily_tables(sections.join(F.broadcast(asked), "date"), settings)
    return resumed(sections.sparkSession, root, settings, dates, ["factor_returns", "residuals", "eligibility"], compute, batch=batch)


def history_job(raw: DataFrame, root: str, settings: dict, *, batch: int = BATCH) -> int:
    """Published cross-sections: raw descriptors by date and security, the styles made of them, and their scores (X.STYLES, X.CONTROLS); the ledger's version. Setting literal: as of scored_styles."""

    def compute(asked: DataFrame) -> dict[str, DataFrame]:
        return {"sections": X.styled(raw.join(F.broadcast(asked), "date"), "date", "cap", "industry", "core", settings.get("literal", False))}

    return resumed(raw.sparkSession, root, settings, raw.select("date").distinct(), ["sections"], compute, batch=batch)
