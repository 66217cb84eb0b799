"""Personal data and what reveals it, in DataFrame functions only.

Base rules find addresses, numbers of cards and phones, and network addresses in whole texts. Then information theory
says which other words give them away. Every sentence of the corpus, counted once however often it is copied, is a context.
An entity (a value that base rules found, without its writing variants) carries IC = log(N / n_e); a term that stands in n_t
contexts, n_et of them with the entity, tells PMI = log(n_et * N / (n_e * n_t)) about it. Where PMI / IC reaches `threshold`
and n_et `support`, the term discloses the entity: it is generalised to its first letters if these disclose less than the
threshold, else removed, in every text that holds the entity. Other texts are left alone.

All counts are exact and over all texts. Contexts of texts with entities give bounds on n_t from below, so only terms that may
reach the threshold are counted in the whole corpus; they are broadcast while they are counted and few, else they meet the
words in a shuffle. Equal sentences are told apart by 64-bit hashes. Counts combine before they are shuffled, so a common
term, entity or copied text is no hot key. Pairs of an entity and a term are made within a sentence, and only for entities
that stand in `support` contexts.

Defined cases: null and empty texts have no spans. Very long texts are measured whole. Rows that repeat, or have no id, are
judged each by itself (rows carry a number of their own). An empty table gives no rows. Columns of the input stay, but for
the text, unless it is kept, and those of OUTPUT.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, few, others, table, written

OUTPUT = ["n_email", "n_ip", "n_card", "n_phone", "spans", "n_terms", "sanitised"]
# Base patterns in their order. Possessive, and starting only where a run of their first characters starts or
# the last match ended, so that long runs take linear time; they match what the plain patterns match.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(KINDS["ip"]), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": lambda t: t.contains("+")}
SENTENCE = r"\n|(?<=[.!?])[\x20\t]++"
LETTERS = r"\p{L}+"
#: Letters of a term at least, and those that stay of a generalised one.
LEAST, STEM = 3, 4
#: Terms that are broadcast at most.
FEW_TERMS = 200_000
SPAN = "struct<start: int, no: int, end: int, kind: string, value: string>"


def proper(kind: str, m: Column) -> Column:
    """Whether a match holds."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def plain(kind: str, m: Column) -> Column:
    """The entity of a match: its kind and value without writing variants."""
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(m, "[^0-9]", "") if kind in ("card", "phone") else F.lower(m))


def placed(text: Column, pattern: str) -> Column:
    """Matches with their places in code points, from what stands between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("all"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["b"])
        end = at + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("all"))

    both = lambda m: F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    return F.get(F.transform(F.array(found), lambda m: F.aggregate(both(m), start, add)["all"]), 0)


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then by kind."""
    none = F.array().cast(f"array<{SPAN}>")
    spans = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        one = lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))
        held = F.filter(placed(text, pattern), lambda s: proper(kind, s["value"]))
        spans.append(F.when(GATES[kind](text), F.transform(held, one)).otherwise(none))
    return F.sort_array(F.concat(*spans))


def entities(text: Column) -> Column:
    """Entities that stand whole in a sentence."""
    found = []
    for kind, pattern in KINDS.items():
        proper_ones = F.filter(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: proper(kind, m))
        found.append(F.when(GATES[kind](text), F.transform(proper_ones, lambda m: plain(kind, m))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*found))


def stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def words(sentence: Column) -> Column:
    """Runs of letters outside addresses."""
    return F.regexp_extract_all(F.when(sentence.contains("@"), F.regexp_replace(sentence, KINDS["email"], " ")).otherwise(sentence), F.lit(LETTERS), 0)


def keys_of(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept, term) of rows (kept, s): terms of sentences and their stems, with repeats."""
    terms = rows.select(*kept, F.explode(words(F.col("s"))).alias("w")).select(*kept, F.lower("w").alias("w")).where(F.char_length("w") >= LEAST)
    return terms.select(*kept, F.explode(F.when(F.char_length("w") > STEM, F.array("w", stem(F.col("w")))).otherwise(F.array("w"))).alias("term"))


def disclosed(n_et: Column, n_e: Column, n_t: Column, n: int) -> Column:
    """PMI over IC; null where the entity carries no information."""
    return F.log(n_et * F.lit(float(n)) / (n_e * n_t)) / F.nullif(F.log(F.lit(float(n)) / n_e), F.lit(0.0))


def disclosing(docs: DataFrame, text: str, found: DataFrame, *, threshold: float, support: int) -> DataFrame:
    """(entity, term, general): terms that disclose entities, and their general form, empty where that discloses as well.

    found: text (of rows with entities) and sentences (hashes, of all rows).
    """
    n = found.select(F.explode("sentences").alias("h")).distinct().count()
    sentences = found.where(F.col("text").isNotNull()).select(F.explode(F.split("text", SENTENCE, -1)).alias("s")).select(F.xxhash64("s").alias("h"), "s")
    contexts = written(sentences.dropDuplicates(["h"]).select("h", "s", entities(F.col("s")).alias("entities")), f"contexts-{uuid.uuid4().hex}")
    held = contexts.select("h", "s", F.explode("entities").alias("entity"))
    often = checkpointed(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support))
    pairs = keys_of(held.join(few(often, FEW_TERMS), "entity"), "h", "entity", "n_e").distinct()
    pairs = checkpointed(pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support))
    below = keys_of(contexts, "h").join(few(checkpointed(pairs.select("term").distinct()), FEW_TERMS), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    maybe = checkpointed(pairs.join(below, "term").where(disclosed(F.col("n_et"), F.col("n_e"), F.col("n_t"), n) >= threshold).drop("n_t"))
    named = ~F.col("term").endswith("*")
    # A stem matters only beside a term of the same entity.
    stems = maybe.where(~named).join(maybe.where(named).select("entity", stem(F.col("term")).alias("term")).distinct(), ["entity", "term"], "left_semi")
    maybe = checkpointed(maybe.where(named).unionByName(stems))
    terms = checkpointed(maybe.select("term").distinct())
    everywhere = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, SENTENCE, -1)).alias("s")).select(F.xxhash64("s").alias("h"), "s")
    counts = keys_of(everywhere, "h").join(few(terms, FEW_TERMS), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    sure = checkpointed(maybe.join(counts, "term").where(disclosed(F.col("n_et"), F.col("n_e"), F.col("n_t"), n) >= threshold).select("entity", "term"))
    bad = sure.where(~named).select("entity", F.col("term").alias("_stem"), F.lit(True).alias("_bad"))
    flagged = sure.where(named).withColumn("_stem", stem(F.col("term"))).join(bad, ["entity", "_stem"], "left")
    return checkpointed(flagged.select("entity", "term", F.when((F.char_length("term") > STEM) & F.col("_bad").isNull(), F.col("_stem")).otherwise("").alias("general")))


def merged(base: Column, terms: Column) -> Column:
    """All spans in order; a term within a base span is left to that."""
    outside = F.filter(terms, lambda t: ~F.exists(base, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return F.sort_array(F.concat(base, outside))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans as their kinds in brackets and terms as their general forms; of spans that overlap, the first stays."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("all"))
    put = lambda s: F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    add = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["all"], F.array(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put(s)))).alias("all"))).otherwise(acc)
    return F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["all"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))


def sanitise(docs: DataFrame, text: str = "text", *, threshold: float = 0.9, support: int = 2, keep_text: bool = True) -> DataFrame:
    """docs with counts of base spans by kind, spans (array of SPAN; kind term for what the method adds, its value the general form), n_terms, and sanitised, the text without them (only with keep_text)."""
    kept = others(docs, *OUTPUT, *([] if keep_text else [text]))
    t = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("_row"), F.col(text).alias("_text")).withColumn("_spans", base_spans(t))
    sentences = F.transform(F.split("_text", SENTENCE, -1), lambda s: F.xxhash64(s))
    rows = written(rows.select("_row", "_spans", F.when(F.size("_spans") > 0, F.col("_text")).alias("text"), sentences.alias("sentences"), F.monotonically_increasing_id().alias("_id")), f"spans-{uuid.uuid4().hex}")
    flagged = disclosing(docs, text, rows, threshold=threshold, support=support)
    concerned = few(checkpointed(flagged.select("entity").distinct()), FEW_TERMS)
    names = F.array_distinct(F.transform("_spans", lambda s: F.coalesce(*[F.when(s["kind"] == k, plain(k, s["value"])) for k in KINDS])))
    # Texts with such entities, then their terms: pairs stay within a text.
    holders = rows.where(F.col("text").isNotNull()).select("_id", "text", F.explode(names).alias("entity")).join(concerned, "entity", "left_semi")
    own = holders.select("_id", "entity", F.explode(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.lower(w)))).alias("term"))
    marks = own.join(flagged, ["entity", "term"]).groupBy("_id", "term").agg(F.min("general").alias("general")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "general"))).alias("_terms"))
    rows = rows.join(few(checkpointed(marks), FEW_TERMS // 10), "_id", "left")
    place = lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("no"), s["end"].alias("end"), F.lit("term").alias("kind"), F.element_at("_terms", F.lower(s["value"])).alias("value"))
    terms = F.transform(F.filter(placed(F.col("text"), LETTERS), lambda s: F.map_contains_key("_terms", F.lower(s["value"]))), place)
    rows = rows.withColumn("spans", F.when(F.col("_terms").isNull(), F.col("_spans")).otherwise(merged(F.col("_spans"), terms)))
    counts = {f"n_{k}": F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long") for k in [*KINDS, "term"]}
    rows = rows.withColumns({**counts, "n_terms": counts["n_term"]})
    last = []
    if keep_text:
        here = F.col(f"_row.`{next(c for c in kept if c.lower() == text.lower())}`")
        last = [F.when(F.size("spans") > 0, sanitised(here, F.col("spans"))).otherwise(here).alias("sanitised")]
    return rows.select("_row.*", *OUTPUT[:-1], *last)


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), "n_terms")
