"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index is written once: postings (term, document, position) of all terms of the test texts in all documents. Phrases
are found by it alone, without a second look at the texts. Each window of an item has two rarest terms; their lists,
shifted by how far apart they stand in the item, are intersected first. Where both meet, the item would lie along a
diagonal of the document (position in the document less position in the item), and the lists of all its other terms are
intersected along that diagonal: places of the item that are met in a row, as many as a window has words, are exact
matches. Proximity matches join lists of the same index within a distance.

Lists of the test side are broadcast while its terms, words and bytes are counted and at most `few_terms`, FEW_WORDS and
FEW_BYTES: each list has at most one row a word of an item, or the words or ids themselves. Beyond any of these postings meet
them in shuffles by term and a salt, so a frequent term is split.

Items are told apart by 64-bit hashes of their words. Null and empty texts have no words and no hits; documents without an
id have hits as others do; items without words have no windows; items without an id hit words but aren't counted. Rows of
one id with different texts are told apart by a hash of the text; equal rows get equal results. Equal items with different
ids all count. Columns of the input stay, but for its text and those that decontaminate() adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, others, table, written

#: Fixed value: words are ASCII letters and digits and all characters beyond ASCII; A-Z only differ in case.
BETWEEN = r"[\p{ASCII}&&\P{Alnum}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ["n_words", "n_hit", "n_items", "items", "contaminated", "n_near"]
#: Terms of the test side that are broadcast at most.
FEW_TERMS = 500_000
#: Words of all items, and bytes of these words and of the items' ids, up to which lists of the test side are broadcast.
FEW_WORDS, FEW_BYTES = 500_000, 32 << 20
#: Documents whose keys are broadcast at most.
FEW_DOCUMENTS = 1_000_000
SALTS = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def item_words(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(item, w, size, need, ids): distinct texts of items as words, how many make a window, and the ids that have the text."""
    rows = items.select(F.col(key).cast("string").alias("id"), words(F.translate(F.col(text), UPPER, LOWER)).alias("w")).where(F.size("w") > 0)
    rows = rows.groupBy("w").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return rows.select(F.xxhash64("w").alias("item"), "w", F.size("w").alias("size"), F.least(F.size("w"), F.lit(width)).alias("need"), "ids")


def meet(index: DataFrame, side: DataFrame, small: bool) -> DataFrame:
    """index and side by term; a shuffle is salted by position."""
    if small:
        return index.join(F.broadcast(side), "term")
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.withColumn("_salt", F.pmod("pos", F.lit(SALTS))).join(salted, ["term", "_salt"]).drop("_salt")


def build_index(docs: DataFrame, terms: DataFrame, small: bool, text: str = "text") -> DataFrame:
    """(keys of docs, term, pos) of each place where a term stands, written. docs: key columns and text; terms: term, A-Z lower-cased."""
    keys = others(docs, text)
    places = docs.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "_token"))
    # Terms meet by a full lower case, which is cheap; then A-Z alone must make them equal.
    sides = terms.select(F.lower("term").alias("term"), F.col("term").alias("_exact"))
    met = meet(places.withColumn("term", F.lower("_token")), sides, small).where(F.translate("_token", UPPER, LOWER) == F.col("_exact"))
    return written(met.select(*keys, F.col("_exact").alias("term"), "pos"), f"postings-{uuid.uuid4().hex}")


def rarest(parts: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """(item, q, term, gap, other) for each window whose terms all occur: its rarest term, at q of the item, and the next rarest, gap words on; null if the window is one word."""
    spread = parts.select("item", "w", "need", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("need"))).alias("s"))
    spread = spread.select("item", "need", "s", F.posexplode(F.slice("w", F.col("s") + 1, F.col("need"))).alias("o", "term"))
    known = spread.join(F.broadcast(counts) if small else counts, "term")
    windows = known.groupBy("item", "need", "s").agg(F.sort_array(F.collect_list(F.struct("n", "term", (F.col("s") + F.col("o")).alias("q")))).alias("by")).where(F.size("by") == F.col("need"))
    first, second = F.get("by", F.lit(0)), F.get("by", F.lit(1))
    return windows.select("item", first["q"].alias("q"), first["term"].alias("term"), (second["q"] - first["q"]).alias("gap"), second["term"].alias("other")).distinct()


def phrases(index: DataFrame, parts: DataFrame, small: bool) -> DataFrame:
    """(keys, start, size, ids): runs of words of a document that equal `need` words or more of an item, counting words from 0."""
    keys = others(index, "term", "pos")
    counts = checkpointed(index.groupBy("term").agg(F.count("*").alias("n")))
    anchors = checkpointed(rarest(parts, counts, small).withColumn("pair", F.xxhash64("term", "other", "gap")))
    pairs = anchors.select("pair", "term", "other", "gap").distinct()
    first = meet(index, pairs.select("term", "pair", F.col("other").isNull().alias("alone")), small).select(*keys, "pair", "alone", F.col("pos").alias("p"))
    second = meet(index, pairs.where("other is not null").select(F.col("other").alias("term"), "pair", "gap"), small).select(*keys, "pair", (F.col("pos") - F.col("gap")).alias("p")).where("p >= 0")
    both = first.where("not alone").join(second, [*keys, "pair", "p"], "left_semi").unionByName(first.where("alone")).drop("alone")
    places = anchors.select("pair", "item", "q")
    diagonals = both.join(F.broadcast(places) if small else places, "pair").select(*keys, "item", (F.col("p") - F.col("q")).alias("diagonal"))
    diagonals = checkpointed(diagonals.distinct())
    # All terms of the item along its diagonals, against the postings of the documents that have one.
    named = checkpointed(diagonals.select(*keys).distinct())
    few = named.count() <= FEW_DOCUMENTS
    own = index.join(F.broadcast(named) if few else named, keys, "left_semi")
    sides = parts.select("item", "w", "need")
    wanted = diagonals.join(F.broadcast(sides) if small else sides, "item").select(*keys, "item", "need", "diagonal", F.posexplode("w").alias("q", "term"))
    met = wanted.withColumn("pos", F.col("diagonal") + F.col("q")).where("pos >= 0").join(own, [*keys, "term", "pos"])
    lines = met.groupBy(*keys, "item", "need", "diagonal").agg(F.sort_array(F.collect_set("q")).alias("qs"))
    # Places in a row differ from their rank by the same number.
    runs = lines.select(*keys, "item", "need", "diagonal", F.inline(F.transform("qs", lambda q, k: F.struct(q.alias("q"), (q - k).alias("run")))))
    runs = runs.groupBy(*keys, "item", "need", "diagonal", "run").agg(F.min("q").alias("q"), F.count("*").cast("int").alias("size")).where("size >= need")
    ids = parts.select("item", "ids")
    return runs.join(F.broadcast(ids) if small else ids, "item").select(*keys, (F.col("diagonal") + F.col("q")).alias("start"), "size", "ids")


def near(index: DataFrame, pairs: DataFrame, within: int, small: bool) -> DataFrame:
    """(keys, a, b, pos_a, pos_b): terms a and b of pairs, at most `within` words apart in either order, each place once."""
    keys = others(index, "term", "pos")
    # Equal blocks of positions, or neighbouring ones, hold all places within reach.
    block = lambda c: F.floor(F.col(c) / (within + 1))
    left = meet(index, pairs.select(F.col("a").alias("term"), "b"), small).withColumnsRenamed({"term": "a", "pos": "pos_a"})
    left = left.withColumn("_block", F.explode(F.array(*[block("pos_a") + k for k in (-1, 0, 1)])))
    right = meet(index, pairs.select(F.col("b").alias("term")).distinct(), small).withColumnsRenamed({"term": "b", "pos": "pos_b"}).withColumn("_block", block("pos_b"))
    return left.join(right, [*keys, "b", "_block"]).where((F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & (F.col("pos_a") != F.col("pos_b"))).select(*keys, "a", "b", "pos_a", "pos_b")


def proximity(docs: DataFrame, pairs: DataFrame, within: int, text: str = "text") -> DataFrame:
    """(keys of docs, a, b, pos_a, pos_b) of pairs (a, b) of terms, by an index of their own; A-Z don't differ in case."""
    pairs = checkpointed(pairs.select(F.translate("a", UPPER, LOWER).alias("a"), F.translate("b", UPPER, LOWER).alias("b")).distinct())
    terms = pairs.select(F.col("a").alias("term")).union(pairs.select("b")).distinct()
    small = within_bounds(pairs.agg(F.count("*"), F.sum(F.octet_length("a") + F.octet_length("b"))))
    return near(build_index(docs, terms, small, text), pairs, within, small)


def within_bounds(sizes: DataFrame) -> bool:
    """Whether lists of so many rows and bytes, one row of both, are small enough to be broadcast."""
    rows, size = sizes.first()
    return rows <= FEW_WORDS and (size or 0) <= FEW_BYTES


def indexed(docs: DataFrame, items: DataFrame, key: str, text: str, width: int, few_terms: int) -> tuple[DataFrame, DataFrame, bool]:
    """The index of docs (its key columns and text), the items, and whether the test side is small."""
    parts = checkpointed(item_words(items, key, text, width))
    terms = checkpointed(parts.select(F.explode("w").alias("term")).distinct())
    size = F.octet_length(F.array_join("w", " ")) + F.octet_length(F.array_join("ids", " "))
    small = terms.count() <= few_terms and within_bounds(parts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.sum(size)))
    return build_index(docs, terms, small), parts, small


def matches(docs: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", *, width: int = 10, few_terms: int = FEW_TERMS) -> DataFrame:
    """(keys of docs, start, size, ids): each run of a document where windows of an item stand. docs: key columns and text."""
    return phrases(*indexed(docs, items, item_key, item_text, width, few_terms))


def near_items(index: DataFrame, parts: DataFrame, small: bool, within: int) -> DataFrame:
    """(keys, n_near): how many items have their two rarest terms at most `within` words apart in the document."""
    keys = others(index, "term", "pos")
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    known = parts.select("item", F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(counts) if small else counts, "term")
    two = known.groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, 2).alias("by")).where(F.size("by") == 2)
    two = checkpointed(two.select("item", F.get("by", F.lit(0))["term"].alias("a"), F.get("by", F.lit(1))["term"].alias("b")))
    found = near(index, two.select("a", "b").distinct(), within, small).select(*keys, "a", "b").distinct()
    per_pair = two.groupBy("a", "b").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(per_pair) if small else per_pair, ["a", "b"]).groupBy(*keys).agg(F.sum("n").alias("n_near"))


def covered(spans: Column) -> Column:
    """How many places sorted spans (start, size) cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, start, step)["n"]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _none, _text, text): lists are joined by equality, which a null id would not meet, so it is a flag beside an id of 0. _text is the hash of the text."""
    some = F.coalesce(F.col(key), F.lit(0).cast(docs.schema[key].dataType))
    return docs.select(some.alias("_id"), F.col(key).isNull().alias("_none"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))


def hits(found: DataFrame) -> DataFrame:
    """By (_id, _none, _text): n_hit and items, of the documents that have hits."""
    spans = F.sort_array(F.collect_set(F.struct("start", "size")))
    return found.groupBy("_id", "_none", "_text").agg(covered(spans).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 10, within: int = 10, few_terms: int = FEW_TERMS) -> DataFrame:
    """docs without its texts, with the columns of COLUMNS: words, words inside a window of an item, the items found, and how many items have their two rarest terms near each other."""
    kept = others(docs, *COLUMNS, text)
    index, parts, small = indexed(keyed(docs, key, text), items, "item_id", "text", width, few_terms)
    found = hits(phrases(index, parts, small)).join(near_items(index, parts, small, within), ["_id", "_none", "_text"], "full_outer")
    some = F.coalesce(F.col(key), F.lit(0).cast(docs.schema[key].dataType))
    rows = docs.select(F.struct(*kept).alias("_row"), some.alias("_id"), F.col(key).isNull().alias("_none"), F.xxhash64(text).alias("_text"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    rows = rows.join(found, ["_id", "_none", "_text"], "left")
    ids = F.coalesce(F.col("items"), F.array().cast(T.ArrayType(T.StringType())))
    n_hit, n_near = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_hit", "n_near"))
    return rows.select("_row.*", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"), n_near.alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 10, few_terms: int = FEW_TERMS, few: int = FEW_DOCUMENTS) -> DataFrame:
    """docs without the rows that have hits; their ids are broadcast while they are counted and few."""
    found = matches(keyed(docs, key, text), items, width=width, few_terms=few_terms)
    found = checkpointed(found.select(F.when(~F.col("_none"), F.col("_id")).alias("_key"), F.col("_text").alias("_t")).distinct())
    if found.count() <= few:
        found = F.broadcast(found)
    return docs.join(found, docs[key].eqNullSafe(found["_key"]) & (F.xxhash64(docs[text]) == found["_t"]), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    rows = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")
