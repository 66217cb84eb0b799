"""Substring deduplication with suffix automata of reference shards.

Two operators. `remove_known` takes a reference of checked size: its shards become suffix automata that are broadcast, and
documents stream past for matching statistics; words in matches of at least `width` words go. `remove_repeats` takes the
corpus as its own reference. That has no size bound, and each document against each shard of it would be quadratic, so
the shards are built around anchors and the texts are dealt to them: every window of `width` words has one anchor, the
least hash of its sequences of eight words, so equal windows have equal anchors. Anchors that occur once need no look.
Where all windows around an anchor agree, they repeat. Elsewhere the distinct passages around an anchor are a shard: its
suffix automaton, weighted by how often a passage occurs, gives the statistics of each of its passages, and windows whose
match occurs twice or more repeat. An anchor with more than `most` distinct passages is no shard, as it may grow without
bound; its windows are counted by their hash, which combines before the shuffle.

Anchors and passages are told apart by 64-bit hashes each, compared together.

Null, empty and short texts keep all their words. Rows that repeat, with equal or different ids, are different documents,
so their windows repeat; rows of one id with different texts are told apart by a hash of the text. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import batches_of, checkpointed, few_rows, table, text_key, with_lists, written
from .near_dedup import HASHES, mix

WIDTH = 35
ANCHOR = 8
#: Documents whose ids are broadcast at most.
FEW_DOCUMENTS = 500_000


def split_words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def anchors(words: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its hash, a hash of the passage that its windows make, and the first and last start of these windows."""
    n = len(words)
    if n < width:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    hashes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    rolled = np.zeros(n - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - ANCHOR + 1 + k]
    rolled = mix(rolled)
    reach = width - ANCHOR + 1
    at = np.lib.stride_tricks.sliding_window_view(rolled, reach).argmin(1) + np.arange(n - width + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    raw = memoryview(hashes.tobytes())
    passage = np.array([xxhash.xxh3_64_intdigest(raw[8 * lo : 8 * (hi + width)], seed=int(p - lo)) for p, lo, hi in zip(at[first], first, last, strict=True)], np.uint64)
    return rolled[at[first]], passage, first, last


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*text_key(key, text), F.col(text).alias("text"))


def anchored(rows: DataFrame, width: int) -> DataFrame:
    """(id, of, anchor, passage, lo, hi) of each anchor of each row (id, of, text)."""

    def run(batches):
        for ids, ofs, texts in batches_of(batches, ["id", "of", "text"]):
            for k in range(0, len(texts), 256):
                found = [anchors(split_words(t), width) for t in texts[k : k + 256]]
                lengths = [len(f[0]) for f in found]
                own = lambda values, kind: pa.array(values[k : k + 256], kind).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
                parts = [np.concatenate([f[i] for f in found]) for i in range(4)]
                yield pa.RecordBatch.from_arrays([own(ids, pa.int64()), own(ofs, pa.int64()), pa.array(parts[0].view(np.int64)), pa.array(parts[1].view(np.int64)), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))], names=["id", "of", "anchor", "passage", "lo", "hi"])

    return rows.transform(few_rows).mapInArrow(run, "id long, of long, anchor long, passage long, lo int, hi int")


def passages(rows: DataFrame, where: DataFrame, width: int) -> DataFrame:
    """(anchor, passage, n, words) of where (anchor, passage, n, at): the words of each distinct passage, read at one of its places."""
    lists = where.groupBy(F.col("at.id").alias("id"), F.col("at.of").alias("of")).agg(F.collect_list(F.struct("anchor", "passage", "n", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))).alias("wanted"))

    def run(batches):
        for texts, wanted in batches_of(batches, ["text", "wanted"]):
            out = []
            for t, some in zip(texts, wanted, strict=True):
                words = split_words(t)
                out += [(w["anchor"], w["passage"], w["n"], b" ".join(words[w["lo"] : w["hi"] + width]).decode()) for w in some]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["anchor", "passage", "n", "words"])

    # Rows that repeat give a passage twice.
    few = lists.count() <= FEW_DOCUMENTS
    ids = lists.select(F.col("id").alias("_i"), F.col("of").alias("_o"))
    needed = rows.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_i")) & (F.col("of") == F.col("_o")), "left_semi") if few else rows
    found = with_lists(needed, lists, where.count(), "inner").select("text", "wanted").transform(few_rows).mapInArrow(run, "anchor long, passage long, n long, words string")
    return found.dropDuplicates(["anchor", "passage"])


def repeated_in_shard(shard: list[tuple], width: int) -> list[int]:
    """By passage (words, weight) the starts, as bits, of windows that occur twice or more in the shard."""
    automaton = SuffixAutomaton()
    for words, weight in shard:
        automaton.add(words, weight)
    masks = []
    for words, _ in shard:
        statistics = automaton.statistics(words, least=2)
        masks.append(sum(1 << (end - width + 1) for end in range(width - 1, len(words)) if statistics[end] >= width))
    return masks


def in_shards(found: DataFrame, width: int) -> DataFrame:
    """(anchor, passage, mask) by suffix automata, one for each anchor's passages."""

    def run(batches):
        def judged(group):
            masks = repeated_in_shard([(words.split(" "), n) for _, _, n, words in group], width)
            return [(a, p, m) for (a, p, _, _), m in zip(group, masks, strict=True)]

        group, out = [], []
        for columns in batches_of(batches, ["anchor", "passage", "n", "words"]):
            for row in zip(*columns, strict=True):
                if group and group[0][0] != row[0]:
                    out += judged(group)
                    group = []
                group.append(row)
            if len(out) > 5000:
                yield as_masks(out)
                out = []
        if group:
            out += judged(group)
        if out:
            yield as_masks(out)

    return found.repartition("anchor").sortWithinPartitions("anchor", "passage").transform(few_rows).mapInArrow(run, "anchor long, passage long, mask long")


def as_masks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor", "passage", "mask"])


def by_counting(found: DataFrame, width: int) -> DataFrame:
    """(anchor, passage, mask) by the number of each window, for anchors with too many passages for one task."""
    words = F.split("words", " ")
    starts = found.select("anchor", "passage", "n", words.alias("w")).select("anchor", "passage", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("i"))
    each = starts.select("anchor", "passage", "n", "i", F.md5(F.array_join(F.slice("w", F.col("i") + 1, width), " ")).alias("window"))
    often = checkpointed(each.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window"))
    return each.join(often, "window").groupBy("anchor", "passage").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def repeats(docs: DataFrame, key: str, text: str, *, width: int = WIDTH, most: int = 1024) -> DataFrame:
    """(id, of, spots): of each document with repeated windows their starts, as (lo, mask): bit k for the window at lo + k."""
    if width - ANCHOR + 1 > 62 or width <= ANCHOR:
        raise ValueError(f"width must be from {ANCHOR + 1} to {ANCHOR + 61}")
    rows = keyed(docs, key, text)
    name = f"repeats-{uuid.uuid4().hex}"
    found = written(anchored(rows, width), f"{name}/anchors")
    again = found.groupBy("anchor").agg(F.count("*").alias("times"), (F.min("passage") != F.max("passage")).alias("mixed")).where("times > 1")
    hits = written(found.join(checkpointed(again.select("anchor", "mixed")), "anchor"), f"{name}/hits")
    clear = hits.where("not mixed").select("id", "of", "lo", F.expr("shiftleft(1L, hi - lo + 1) - 1").alias("mask"))
    distinct = checkpointed(hits.where("mixed").groupBy("anchor", "passage").agg(F.count("*").alias("n"), F.min(F.struct("id", "of", "lo", "hi")).alias("at")))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("passages"))
    texts = checkpointed(passages(rows, distinct, width).join(sizes, "anchor"))
    masks = in_shards(texts.where(F.col("passages") <= most).drop("passages"), width).unionByName(by_counting(texts.where(F.col("passages") > most), width))
    masks = checkpointed(masks.where("mask <> 0"))
    judged = hits.where("mixed").join(masks, ["anchor", "passage"]).select("id", "of", "lo", "mask")
    return clear.unionByName(judged).groupBy("id", "of").agg(F.collect_list(F.struct("lo", "mask")).alias("spots"))


def stripped(words: list[bytes], spots: list[dict], width: int) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int32)
    for spot in spots:
        mask, start = spot["mask"], spot["lo"]
        while mask:
            if mask & 1:
                gone[start] += 1
                gone[start + width] -= 1
            mask >>= 1
            start += 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH, most: int = 1024) -> DataFrame:
    """(key, n_words, n_removed, kept): kept is the text that is left, words joined by one space."""
    spots = checkpointed(repeats(docs, key, text, width=width, most=most))
    entries = spots.select(F.sum(F.size("spots"))).first()[0] or 0
    rows = with_lists(keyed(docs, key, text), spots, entries, "left")

    def run(batches):
        for ids, texts, some in batches_of(batches, ["id", "text", "spots"]):
            out = []
            for t, s in zip(texts, some, strict=True):
                words = split_words(t)
                left = stripped(words, s, width) if s else words
                out.append((len(words), len(words) - len(left), b" ".join(left).decode()))
            n, removed, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "spots").transform(few_rows).mapInArrow(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", key)


def remove_known(docs: DataFrame, reference: DataFrame, key: str = "doc_id", text: str = "text", reference_text: str = "text", *, width: int = WIDTH, shard_words: int = 200_000, most_words: int = 2_000_000) -> DataFrame:
    """(key, n_words, n_removed, kept): words in matches of at least `width` words with a reference text go.

    The reference may have most_words words, else it is refused; a shard has about shard_words. Shards' automata are built by tasks
    from broadcast texts, once a worker.
    """
    sized = reference.where(F.col(reference_text).isNotNull()).select(F.col(reference_text).alias("r"))
    total = sized.select(F.sum(F.regexp_count("r", F.lit(r"\S+")))).first()[0] or 0
    if total > most_words:
        raise ValueError(f"the reference has {total} words; at most {most_words} are broadcast")
    shards, size = [[]], 0
    for (r,) in sized.toLocalIterator():
        shards[-1].append(r)
        size += len(r.split())
        if size >= shard_words:
            shards.append([])
            size = 0
    shared = docs.sparkSession.sparkContext.broadcast([s for s in shards if s])

    def run(batches):
        automata = []
        for shard in shared.value:
            automata.append(SuffixAutomaton())
            for r in shard:
                automata[-1].add(split_words(r))
        for ids, texts in batches_of(batches, ["id", "text"]):
            out = []
            for t in texts:
                words = split_words(t)
                gone = np.zeros(len(words) + 1, np.int32)
                for automaton in automata:
                    for end, longest in enumerate(automaton.statistics(words)):
                        if longest >= width:
                            gone[end - longest + 1] += 1
                            gone[end + 1] -= 1
                left = [w for w, k in zip(words, (np.cumsum(gone[:-1]) == 0).tolist(), strict=True) if k]
                out.append((len(words), len(words) - len(left), b" ".join(left).decode()))
            n, removed, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return keyed(docs, key, text).select("id", "text").transform(few_rows).mapInArrow(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", key)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
