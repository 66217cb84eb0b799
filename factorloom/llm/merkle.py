"""Merkle manifest of a dataset as a postorder append log.

Every row is a leaf. The leaves of a group stand in order, each run of eight nodes has one parent, and the groups' roots form
one more such tree. Leaves get their places from one range-sorted, written pass (no group is sorted in one task), then aligned
builders each take 8 ** LEVELS consecutive leaves and append nodes to a log in the order in which they complete: a leaf, then
every parent whose last leaf it is. So the place of any node in the log follows from the sizes of the subtrees before it
(`place`), and builders and proofs find children and siblings by it. The roots of those segments are the leaves of the next
tier, which 8 ** LEVELS times fewer rows go to, until one node of each group is left. Proofs come down the tiers again: each
segment reads the siblings of its nodes from its own log and adds the path of its root.

Texts are hashed before anything is shuffled; segments are written, so lost executors cost one segment's work. Groups and
segments meet in joins, broadcast only while they are counted and few.

Defined cases: nulls have their own form in a leaf, and a null group or a null key comes first. Empty and very long texts are
texts. Rows that repeat are leaves of their own, side by side; rows of one key stand by their digests. An empty table has no
rows and no root. Of the input's columns only those of `keep` stay, and of these not what has a name of OUTPUT.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, few, others, remainder, table, written

OUTPUT = ["leaf", "subroot", "root", "proof", "claim", "folded_root", "verified"]
PATH = "array<struct<before: string, after: string>>"
#: Levels of a segment; it has at most 8 ** LEVELS leaves.
LEVELS = 3
#: Segments or runs that are broadcast at most.
FEW = 20_000


def place(level: int, index: int, n: int, height: int) -> int:
    """Where node `index` of a level stands in the log of a tree of n leaves.

    Its last leaf e completes it; by then e >> 3j nodes of level j have been completed by leaves before e, and e itself
    completes one node of each level up to this one.
    """
    e = min((index + 1) << 3 * level, n) - 1
    return sum(e >> 3 * j for j in range(height + 1)) + level


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    h = 0
    while 1 << 3 * h < n:
        h += 1
    return h


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def appended(leaves: list[str], height: int) -> list[str]:
    """The log of a tree: each leaf, then the parents that it completes."""
    log, n = [], len(leaves)
    for e, leaf in enumerate(leaves):
        log.append(leaf)
        for level in range(1, height + 1):
            if (e + 1) % (1 << 3 * level) and e + 1 < n:
                break
            index = e >> 3 * level
            children = range(index << 3, min((index + 1) << 3, -(-n // (1 << 3 * (level - 1)))))
            log.append(digest(*[log[place(level - 1, c, n, height)] for c in children]))
    return log


def path_of(log: list[str], leaf: int, n: int, height: int) -> list[dict]:
    """The siblings of a leaf and of each node above it but the root: those before and those after, joined."""
    found = []
    for level in range(height):
        index = leaf >> 3 * level
        first, end = index >> 3 << 3, min((index >> 3) + 1 << 3, -(-n // (1 << 3 * level)))
        at = [log[place(level, c, n, height)] for c in range(first, end)]
        found.append({"before": "".join(at[: index - first]), "after": "".join(at[index - first + 1 :])})
    return found


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each with its length in bytes before it."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (_by, _order, leaf, ...) with `at`, their place in the group, and n, its size."""
    order = [F.col("_by").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("leaf"), F.col("_tie")]  # _tie parts equal rows
    rows = leaves.withColumn("_tie", F.rand(13)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, f"leaves-{uuid.uuid4().hex}").withColumn("_part", F.shiftright("_id", 33))
    runs = rows.groupBy(F.col("_by").alias("_b"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count("*").alias("_m"))
    # A group has one run in each partition at most.
    runs = runs.selectExpr("*", "sum(_m) over (partition by _b order by _p) - _m as _before", "sum(_m) over (partition by _b) as n")
    rows = rows.join(few(checkpointed(runs), FEW), F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")))
    return rows.withColumn("at", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_b", "_p", "_first", "_m", "_before", "_order")


def segments(nodes: DataFrame, tier: int) -> DataFrame:
    """(_by, chunk, n, leaves, log, rows) of nodes (_by, at, n, leaf, row): the logs of aligned builders."""
    kind = {c: nodes.schema[c].dataType for c in ("_by", "row")}
    fields = {"_by": kind["_by"], "chunk": T.LongType(), "n": T.LongType(), "leaves": T.IntegerType(), "height": T.IntegerType(), "log": T.BinaryType(), "rows": T.ArrayType(kind["row"])}

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n, m = rows["n"][0].as_py(), rows.num_rows
        height = max(0, min(LEVELS, height_of(n) - LEVELS * tier))
        log = appended([x.hex() for x in rows["leaf"].to_pylist()], height)
        held = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), rows["row"].combine_chunks())
        own = [rows["_by"].combine_chunks().slice(0, 1), pa.array([rows["chunk"][0].as_py()]), pa.array([n]), pa.array([m], pa.int32()), pa.array([height], pa.int32()), pa.array([bytes.fromhex("".join(log))], pa.binary()), held]
        return pa.Table.from_arrays(own, names=list(fields))

    schema = T.StructType([T.StructField(k, v) for k, v in fields.items()])
    chunks = nodes.withColumn("chunk", F.shiftright("at", 3 * LEVELS)).groupBy("_by", "chunk").applyInArrow(build, schema)
    return written(chunks, f"log-{uuid.uuid4().hex}")


def tiers_of(nodes: DataFrame) -> list[DataFrame]:
    """Segments of every tier, from the leaves up."""
    tiers = [segments(nodes, 0)]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    for tier in range(1, -(-height_of(most) // LEVELS)):
        roots = tiers[-1].select("_by", F.col("chunk").alias("at"), "n", F.substring("log", -32, 32).alias("leaf"), F.struct(F.lit(True).alias("_")).alias("row"))
        tiers.append(segments(roots, tier))
    return tiers


def log_of(tiers: list[DataFrame]) -> DataFrame:
    """(_by, position, level, node): all nodes of every group's tree, by their places in its log."""

    def spread(tier: int):
        def nodes(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for by, chunk, n, m, h, log in zip(*[batch.column(i) for i in range(6)], strict=True):
                    chunk, n, m, h, log = chunk.as_py(), n.as_py(), m.as_py(), h.as_py(), log.as_py().hex()
                    height, found = height_of(n), []
                    for level in range(1 if tier else 0, h + 1):  # the leaves of an upper tier are in the one below
                        for i in range(-(-m // (1 << 3 * level))):
                            at, above = place(level, i, m, h), LEVELS * tier + level
                            found.append((place(above, (chunk << 3 * (LEVELS - level)) + i, n, height), above, log[64 * at : 64 * at + 64]))
                    columns = [list(c) for c in zip(*found, strict=True)] or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array([by.as_py()] * len(found), batch.column(0).type), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["_by", "position", "level", "node"])

        return nodes

    logs = None
    for tier, chunks in enumerate(tiers):
        schema = T.StructType([chunks.schema["_by"], *T._parse_datatype_string("position long, level int, node string").fields])
        more = chunks.select("_by", "chunk", "n", "leaves", "height", "log").mapInArrow(spread(tier), schema)
        logs = more if logs is None else logs.unionByName(more)
    return logs


def paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(_by, row, at, leaf, proof, ...) of the leaves; tops has (_by, proof, ...) of each group's root, whose further columns stay."""
    more = [c for c in tops.columns if c not in ("_by", "proof")]
    above = tops.withColumn("_chunk", F.lit(0).cast("long"))
    for tier in reversed(range(len(tiers))):
        chunks = tiers[tier]
        above = few(checkpointed(above.withColumnRenamed("_by", "_b")), FEW)
        joined = chunks.join(above, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("chunk") == F.col("_chunk"))).select("_by", "chunk", "leaves", "height", "log", "rows", "proof", *more)

        def spread(batches, names=tuple(joined.columns)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = {c: batch.column(i)[k] for i, c in enumerate(names)}
                    m, h, text = one["leaves"].as_py(), one["height"].as_py(), one["log"].as_py().hex()
                    log, upper, chunk = [text[i : i + 64] for i in range(0, len(text), 64)], one["proof"].as_py(), one["chunk"].as_py()
                    repeated = lambda c: pa.array([one[c].as_py()] * m, one[c].type)  # noqa: B023, E731
                    own = [repeated("_by"), one["rows"].values, pa.array(range(chunk << 3 * LEVELS, (chunk << 3 * LEVELS) + m)), pa.array([log[place(0, i, m, h)] for i in range(m)]), pa.array([path_of(log, i, m, h) + upper for i in range(m)], one["proof"].type)]
                    yield pa.RecordBatch.from_arrays([*own, *map(repeated, more)], ["_by", "row", "at", "leaf", "proof", *more])

        row = chunks.schema["rows"].dataType.elementType
        schema = T.StructType([chunks.schema["_by"], T.StructField("row", row), *T._parse_datatype_string(f"at long, leaf string, proof {PATH}").fields, *[tops.schema[c] for c in more]])
        found = joined.mapInArrow(spread, schema)
        above = found.select("_by", F.col("at").alias("_chunk"), "proof", *more)
    return found


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, columns: list[str], by: str, order: str, *, keep: list[str], claimed: dict[str, Column] | None = None, claims: Column | None = None) -> DataFrame:
    """Columns `keep`, and OUTPUT: leaf, subroot, root, proof (siblings before and after, level by level up to the root) and a check.

    columns are hashed in the order given; by is the group. Where `claims` is true, the row is checked as if it had the
    values of `claimed`; claim is that leaf, folded_root what it and the proof give, verified whether that is the root.
    """
    spark, kept = docs.sparkSession, others(docs.select(*keep), *OUTPUT)
    changed = leaf_digest([(claimed or {}).get(c, F.col(c)) for c in columns])
    claim = F.when(claims, changed) if claims is not None else F.lit(None).cast("binary")
    row = F.struct(F.struct(*[F.col(c) for c in kept]).alias("row"), claim.alias("claim"))
    leaves = docs.select(F.col(by).alias("_by"), F.col(order).alias("_order"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), row.alias("row"))
    tiers = tiers_of(ranked(leaves))
    roots = tiers[-1].select(F.lit(0).alias("_by"), F.col("_by").alias("_order"), F.substring("log", -32, 32).alias("leaf"), F.struct(F.col("_by").alias("by")).alias("row"))
    upper = tiers_of(ranked(roots))
    top = upper[-1].select(F.lower(F.hex(F.substring("log", -32, 32))).alias("root")).first()
    none = spark.createDataFrame([(0, [])], f"_by int, proof {PATH}")
    tops = paths(upper, none).select(F.col("row.by").alias("_by"), "proof", F.col("leaf").alias("subroot"))
    found = paths(tiers, tops)
    claim = F.coalesce(F.lower(F.hex("row.claim")), F.col("leaf"))
    out = found.select("row.row.*", "leaf", "subroot", F.lit(top and top["root"]).cast("string").alias("root"), "proof", claim.alias("claim"))
    return out.withColumn("folded_root", folded(F.col("claim"), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", keep=["doc_id"], claimed={"text": F.translate("text", upper, upper.lower())}, claims=remainder("doc_id", 3) == 0)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
