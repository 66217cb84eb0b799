"""What the operators of this subpackage share: tables, checkpoints, word rules."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space characters.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of df but those of the names, which an operator adds or drops; case makes no difference, as in Spark."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's shared folder, or a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def ascii_words(text: str | None) -> list[bytes]:
    """Words of the text as bytes, A-Z lower-cased; bytes.split() splits at exactly the ASCII white space of WORD."""
    return text.encode().translate(LOWER_BYTES).split() if text else []


#: Rows of an Arrow batch at most: texts may be long, and a batch is held by the executor and its Python worker at once.
BATCH_ROWS = 512


def few_rows(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches made small.

    The setting is read when the plan is run, which may be long after it is made, so it stays as it is set.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def batches_of(batch_iter, columns: list[str]) -> Iterator[tuple]:
    """Each Arrow batch as Python lists of the named columns."""
    for batch in batch_iter:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)


#: Entries of lists that are broadcast at most; each is a few numbers.
FEW_ENTRIES = 200_000


def text_key(key: str, text: str):
    """Columns id and of: what tells rows apart, also where rows of one id have different texts."""
    return [F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("of")]


def with_lists(rows: DataFrame, lists: DataFrame, entries: int, how: str) -> DataFrame:
    """rows with the list of their (id, of); the lists are broadcast while their entries are counted and few."""
    lists = lists.withColumnsRenamed({"id": "_id", "of": "_of"})
    return rows.join(F.broadcast(lists) if entries <= FEW_ENTRIES else lists, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")), how).drop("_id", "_of")


def written(df: DataFrame, folder: str) -> DataFrame:
    """df written as Parquet to a new folder below the checkpoint folder, and read again."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{folder}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def few(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast if it has at most `most` rows; it is counted, so it should be stored."""
    return F.broadcast(df) if df.count() <= most else df
