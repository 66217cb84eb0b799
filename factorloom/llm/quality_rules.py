"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed base rules reject texts that are too short or repeat themselves. The other limits adapt: mergeable KLL sketches hold
the quartiles of each measure by language and source; a group of few documents uses the merged sketches of its language,
and a small language those of all documents. A measure beyond its quartile by `reach` times the quartile range (or a least
range, where nearly all documents agree) rejects the text. Texts are measured once and the measures written; sketches and verdicts
are made from those. Sketches combine before the shuffle, so a source of any size is cheap; documents meet their group's
limits in a broadcast join while the groups are counted and few, else in a plain join.

Null and empty texts have no words and fail the base rules. Null languages and sources are groups like others. Rows that
repeat are each judged. Columns of the input stay, but for those that judge() adds (and the text, if it isn't kept).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, checkpointed, others, table, written

#: Measure: (least quartile range, whether too small rejects too).
MEASURES = {"symbol_share": (0.025, False), "upper_share": (0.12, False), "mean_word": (2.0, True), "line_share": (0.1, False), "repeat_share": (0.05, False)}
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
#: Groups that are broadcast at most; a row has a dozen numbers.
FEW_GROUPS = 50_000


def counted(docs: DataFrame, text: str) -> DataFrame:
    """The counts that need no word list."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "n_words": F.regexp_count(t, F.lit(WORD)).cast("long"),
            "word_chars": (F.char_length(t) - F.regexp_count(t, F.lit(f"[{SPACE_CLASS}]"))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        }
    )


def measured(docs: DataFrame, text: str) -> DataFrame:
    """docs with all counts, and the measures that have limits; null where there is nothing to divide by."""
    chars, words, lines = (F.nullif(F.col(c), F.lit(0)) for c in ("word_chars", "n_words", "_lines"))
    shares = {"symbol_share": F.col("n_symbols") / chars, "upper_share": F.col("_upper") / chars, "mean_word": F.col("word_chars") / words, "line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words}
    return repeats(counted(docs, text), text).withColumns(shares)


def held(value: Column, use) -> Column:
    """use(value) with value evaluated once for each row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def twice_covered(words: Column) -> Column:
    """How many words stand in five-word windows that occur twice or more. Only texts with equal hashes of windows are looked at again, on the windows themselves."""
    starts = F.when(F.size(words) >= 5, F.sequence(F.lit(0), F.size(words) - 5)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 5)).alias("w"), i.alias("i"))))

    def covered(found: Column) -> Column:
        text_at = lambda k: F.coalesce(F.get(found, k)["w"], F.lit(""))
        twice = F.filter(found, lambda x, k: (x["w"] == text_at(k + 1)) | (x["w"] == text_at(k - 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(places, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")))["n"]

    return held(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), held(windows, covered)).otherwise(0))


def repeats(docs: DataFrame, text: str) -> DataFrame:
    """n_dup_lines, _lines (those with a word) and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    of_lines = held(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    docs = docs.withColumn("_of_lines", of_lines)
    again = F.col("_of_lines.all") - F.col("_of_lines.distinct")
    return docs.withColumns({"_lines": F.col("_of_lines.all"), "n_dup_lines": again.cast("long"), "n_repeat_words": held(F.regexp_extract_all(t, F.lit(f"({WORD})")), twice_covered).cast("long")})


def thresholds(rows: DataFrame, *, reach: float, least_group: int, k: int) -> DataFrame:
    """By _lang and _source the lower and upper limit of each measure, from sketches of all measured rows that have words."""
    sketches = checkpointed(rows.where("n_words > 0").groupBy("_lang", "_source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in MEASURES]))
    merged = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in MEASURES])
    by_lang, of_all = merged(sketches, "_lang"), merged(sketches)
    up = by_lang.select(F.col("_lang").alias("_l"), F.col("n").alias("ln"), *[F.col(m).alias(f"l_{m}") for m in MEASURES])
    top = of_all.select(*[F.col(m).alias(f"a_{m}") for m in MEASURES])
    groups = sketches.join(up, F.col("_lang").eqNullSafe(F.col("_l")), "left").join(F.broadcast(top), how="left")  # one row
    limits = []
    for m, (least, both) in MEASURES.items():
        sketch = F.when(F.col("n") >= least_group, F.col(m)).when(F.col("ln") >= least_group, F.col(f"l_{m}")).otherwise(F.col(f"a_{m}"))
        low, high = F.kll_sketch_get_quantile_double(sketch, F.lit(0.25)), F.kll_sketch_get_quantile_double(sketch, F.lit(0.75))
        wide = reach * F.greatest(high - low, F.lit(least))
        limits += [(low - wide if both else F.lit(float("-inf"))).alias(f"_{m}_low"), (high + wide).alias(f"_{m}_high")]
    return groups.select(F.col("_lang").alias("_of_lang"), F.col("_source").alias("_of_source"), *limits)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, reach: float = 3.0, least_group: int = 100, k: int = 400, keep_text: bool = True) -> DataFrame:
    """docs with the counts of COLUMNS, base_failed and kept."""
    kept = others(docs, *COLUMNS, *([] if keep_text else [text]))
    # The input's columns stay apart in a struct, so their names don't matter.
    rows = docs.select(F.struct(*kept).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    rows = written(measured(rows, "_text").select("_row", "_lang", "_source", *COLUMNS[:5], *MEASURES), f"measures-{uuid.uuid4().hex}")
    limits = checkpointed(thresholds(rows, reach=reach, least_group=least_group, k=k))
    if limits.count() <= FEW_GROUPS:
        limits = F.broadcast(limits)
    rows = rows.join(limits, F.col("_lang").eqNullSafe(F.col("_of_lang")) & F.col("_source").eqNullSafe(F.col("_of_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    beyond = F.lit(False)
    for m in MEASURES:
        beyond |= F.coalesce((F.col(m) > F.col(f"_{m}_high")) | (F.col(m) < F.col(f"_{m}_low")), F.lit(False))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~beyond)
    return rows.select("_row.*", *COLUMNS)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False).select("doc_id", *COLUMNS)
