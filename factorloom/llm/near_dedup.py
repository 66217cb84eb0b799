"""Near-duplicate documents by fast similarity sketching.

A document is its set of five-word shingles. The sketch has `size` coordinates: in each round every shingle is hashed to a
bin and a value, and the first rounds that leave a bin full decide it; after `size` rounds each further round puts all
shingles into one bin in turn, so every coordinate fills. Equal coordinates estimate the Jaccard similarity with Chernoff
bounds. Bands of coordinates give buckets, and links are confirmed on full sets.

Documents with equal sets are one class first, so groups of copies of any size are one row. In each bucket all classes are
compared with the smallest and the largest id there (two stars, linear in the bucket). After components are known, only
buckets that still hold several components are left; there members of the largest component meet the others, and those
each other, in blocks of bounded size, each pair of blocks in a group of its own; what a block finds is links, not pairs. So no link between bucket mates is lost and no group is collected unbounded.

A pair at similarity 0.75 meets in no bucket with probability (1 - 0.75^4)^40, 3e-7. Sets hold 64-bit hashes.

Null and empty texts have no set, link with nothing and are kept. Rows without an id are kept and link with nothing. Rows
that share an id count as linked. Ties: the smallest id of a component stays. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, batches_of, checkpointed, few_rows, table
from .graph import components

SHINGLE = 5
BANDS, ROWS = 40, 4
#: Items of sets in a block, and in a chunk of a bucket's largest label.
BLOCK, CHUNK = 200_000, 400_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hash of a word, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word sequences; a text of fewer words is one sequence."""
    words = ascii_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    take = min(width, n)
    total = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        total = mix(total + hashes[k : n - take + 1 + k])
    return np.unique(total)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of `size` coordinates for each non-empty set."""
    out = np.full((len(sets), size), ~np.uint64(0))
    flat = out.ravel()
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    low = np.uint64((1 << 48) - 1)
    for turn in range(2 * size):
        if not len(items):
            break
        h = mix(items + mix(np.array([turn + 1], np.uint64)))
        place = ((h >> np.uint64(48)) * np.uint64(size) >> np.uint64(16)).astype(np.int64) if turn < size else turn - size
        np.minimum.at(flat, owner * size + place, (h & low) | (np.uint64(turn) << np.uint64(48)))
        rows = np.unique(owner)
        still = np.zeros(len(sets), bool)
        still[rows] = (out[rows] == ~np.uint64(0)).any(1)
        left = still[owner]
        items, owner = items[left], owner[left]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sketch), 1))
    parts = sketch.reshape(len(sketch), bands, rows)
    for k in range(rows):
        keys = mix(keys + parts[:, :, k])
    return keys


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, set_hash, bands) of each row; empty sets have no bands."""

    def run(batches):
        for batch in batches:
            for ids, texts in batches_of([batch], [key, text]):
                for k in range(0, len(texts), 128):
                    sets = [shingles(t) for t in texts[k : k + 128]]
                    full = [s for s in sets if len(s)]
                    keys = band_keys(sketches(full, BANDS * ROWS), BANDS, ROWS).view(np.int64) if full else np.empty((0, BANDS), np.int64)
                    lengths = [BANDS if len(s) else 0 for s in sets]
                    starts = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[k : k + 128], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.ListArray.from_arrays(starts, pa.array(keys.ravel()))],
                        names=["id", "n", "set_hash", "bands"],
                    )

    return docs.select(F.col(key).cast("long").alias(key), text).transform(few_rows).mapInArrow(run, "id long, n long, set_hash string, bands array<long>")


def full_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, items)."""

    def run(batches):
        for ids, texts in batches_of(batches, [key, text]):
            for k in range(0, len(texts), 256):
                sets = [shingles(t) for t in texts[k : k + 256]]
                starts = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 256], pa.int64()), pa.ListArray.from_arrays(starts, pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "items"])

    return docs.select(F.col(key).cast("long").alias(key), text).transform(few_rows).mapInArrow(run, "id long, items array<long>")


def needed_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, few: int = 1_000_000) -> DataFrame:
    """Sets of the documents in ids (id), which are broadcast while they are counted and few."""
    ids = ids.withColumnRenamed("id", "_id")
    wanted = F.broadcast(ids) if ids.count() <= few else ids
    return full_sets(docs.select(key, text).join(wanted, F.col(key) == F.col("_id"), "left_semi"), key, text)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    # Sizes alone rule many pairs out.
    possible = (100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    return both.where(possible).where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def links_in_block(ids: list, sides: list, labels: list, sets: list, percent: int) -> list:
    """Links across labels between the two sides of a pair of blocks (or within one block), by counting shared items in an index."""
    index: dict[int, list[int]] = {}
    found = []
    for k in sorted(range(len(ids)), key=lambda i: sides[i]):
        shared: dict[int, int] = {}
        for x in sets[k]:
            for other in index.get(x, ()):
                shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if labels[other] != labels[k] and 100 * n >= percent * (len(sets[k]) + len(sets[other]) - n):
                found.append((ids[other], ids[k]))
        if sides[k] == 0:
            for x in sets[k]:
                index.setdefault(x, []).append(k)
    return found


def rest(buckets: DataFrame, labels: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Links (a, b) between different labels within buckets (bucket, id, n) that hold several.

    Members of a bucket's largest label need no look at each other, so they are dealt into chunks that meet the blocks of
    the other members; these also meet each other. Rows grow with the largest label times the blocks of the others.
    """
    labelled = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    by_label = labelled.groupBy("bucket", "label").agg(F.sum("n").alias("items"), F.count("*").alias("members"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    sums = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("items").alias("items"), F.sum("members").alias("members"), F.max(F.struct("items", "label")).alias("main"), F.sum("who").alias("who"))
    # Buckets with the same members are one.
    several = sums.where("labels > 1").groupBy("members", "who").agg(F.min(F.struct("bucket", "main", "items")).alias("b"))
    parts = lambda items, most: F.ceil(items / F.lit(most)).cast("long")
    open_buckets = checkpointed(several.select("b.bucket", F.col("b.main.label").alias("main"), parts(F.col("b.main.items"), CHUNK).alias("chunks"), parts(F.col("b.items") - F.col("b.main.items"), BLOCK).alias("blocks")))
    members = checkpointed(labelled.join(open_buckets, "bucket"))
    if members.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("id", "bucket"), F.when(is_main, F.col("chunks")).otherwise(F.col("blocks")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    against_blocks = F.transform(upto(F.col("blocks")), lambda y: cell("main", F.col("own"), y, F.lit(1)))
    against_chunks = F.transform(upto(F.col("chunks")), lambda x: cell("main", x, F.col("own"), F.lit(0)))
    among = F.transform(upto(F.col("blocks")), lambda y: cell("others", F.least("own", y), F.greatest("own", y), F.when(F.col("own") <= y, 0).otherwise(1)))
    cells = F.when(is_main, against_blocks).otherwise(F.concat(against_chunks, among))
    group = members.withColumn("own", own).select("bucket", "id", "label", F.explode(cells).alias("cell")).select("bucket", "id", "label", "cell.*")
    sets = needed_sets(docs, members.select("id").distinct(), key, text)
    rows = group.join(sets, "id")

    def compare(pdf):
        import pandas as pd

        within = pdf["kind"].iloc[0] == "others" and pdf["x"].iloc[0] == pdf["y"].iloc[0]
        found = links_in_block(pdf["id"].tolist(), [0] * len(pdf) if within else pdf["side"].tolist(), pdf["label"].tolist(), [s.tolist() for s in pdf["items"]], percent)
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("bucket", "kind", "x", "y").applyInPandas(compare, "a long, b long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", *, percent: int = 75) -> DataFrame:
    """Of each row (key, n_shingles, component_id, kept)."""
    rows = checkpointed(sketched(docs, key, text))
    usable = rows.where("n > 0 and id is not null")
    classes = checkpointed(usable.groupBy("n", "set_hash").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    banded = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("bucket"))
    shared = checkpointed(banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("members")).where("low <> high"))
    buckets = checkpointed(banded.join(shared, "bucket"))
    to_low = buckets.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    to_high = buckets.where("id <> low and id <> high").select(F.col("id").alias("a"), F.col("high").alias("b"))
    star = checkpointed(to_low.union(to_high).distinct())
    sets = checkpointed(needed_sets(docs, star.select(F.col("a").alias("id")).union(star.select("b")).distinct(), key, text))
    links = checkpointed(confirmed(star, sets, percent))
    labels = components(links)
    # The smallest and the largest id have met everyone; of three members or fewer no pair is left.
    open_members = buckets.where("members > 3 and id <> low and id <> high").select("bucket", "id", "n")
    more = checkpointed(rest(open_members, labels, docs, key, text, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    named = classes.select("n", "set_hash", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(F.col("n").alias("_n"), F.col("set_hash").alias("_s"), F.coalesce("label", "rep").alias("component"))
    out = rows.select("id", "n", "set_hash").join(checkpointed(named), (F.col("n") == F.col("_n")) & (F.col("set_hash") == F.col("_s")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
