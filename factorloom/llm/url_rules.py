"""URL filter: fixed host and path rules, then association rules mined by FP-growth.

A url becomes a set of tokens (top-level domain, parts of the host, path parts, parameter names and the scheme).
FP-growth runs on two thirds of the labelled urls, each a set of tokens and its label; of its association rules those that
conclude `block` stay if their confidence and support reach the limits, if no rule with fewer tokens is as confident, and
if they hold on the other third beyond chance. They match by an inverted index: a rule is kept under each of its tokens,
urls' tokens join the index, and a rule fires where as many tokens met it as it has. A url that no rule blocks is allowed.
Where labels say nothing about urls no rule is proven, and only the fixed rules block.

A url's label comes from the document it serves: the last number in its path is a document id; low quality or toxicity
means block. Urls that have none or no labelled document are not mined, but judged.

Null urls and urls without `://` have empty host and path, no tokens, and are allowed. Rows that repeat are each judged;
distinct urls are matched once. Columns of the input stay, but for those that judge() adds. With no labels or no frequent tokens there are no mined rules. Ties between fixed rules
can't occur: the longest host suffix wins, then the longest path.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, others, table

#: Verdict, host, path prefix.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits best and its verdict, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(urls: DataFrame) -> Column:
    """Distinct tokens of _url, host and path: each part of the url gives one. Numbers are a kind, not themselves."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    top = F.transform(F.slice(labels, -1, 1), lambda x: F.concat(F.lit("top:"), x))
    words = F.transform(F.filter(F.flatten(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    steps = F.transform(F.filter(F.split("path", r"[/.\-_]"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.when(x.rlike(r"\A[0-9]+\z"), F.lit("number")).otherwise(x)))
    names = F.transform(F.regexp_extract_all("_url", F.lit(r"[?&]([^=&#]+)")), lambda x: F.concat(F.lit("parameter:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract("_url", r"\A([A-Za-z]+)://", 1)))
    return F.when(F.size(labels) > 0, F.array_distinct(F.concat(top, words, steps, names, scheme))).otherwise(F.array().cast("array<string>"))


def split_urls(urls: DataFrame) -> DataFrame:
    """From `_url`: host, path and tokens."""
    host, path = parts(F.col("_url"))
    urls = urls.withColumns({"host": host, "path": path})
    return urls.withColumn("tokens", tokens(urls))


def representatives(labelled: DataFrame, least: float, most: float) -> dict[str, str]:
    """By useful token the one that stands for it: tokens that the same urls have are one token, the shortest, then the first.

    Useful are tokens of at least `least` blocked urls and fewer than `most` urls; there are at most tokens of a url / support of them.
    """
    mark = lambda seed: F.sum(F.pmod(F.xxhash64("_url", F.lit(seed)), F.lit(1 << 31)))
    seen = labelled.select("_url", "blocked", F.explode("tokens").alias("token")).groupBy("token")
    found = seen.agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"), mark(1).alias("one"), mark(2).alias("two")).where((F.col("bad") >= least) & (F.col("n") < most))
    shortest = F.min(F.struct(F.length("token"), F.col("token"))).over(Window.partitionBy("n", "bad", "one", "two"))
    return {r["token"]: r["by"] for r in found.select("token", shortest["token"].alias("by")).collect()}


def mine(labelled: DataFrame, *, support: float, confidence: float) -> DataFrame:
    """Rules that conclude block, by FP-growth: rule_id, tokens, confidence. labelled: _url, tokens, blocked (boolean).

    Tokens that nearly every url has (over nine tenths) say nothing; of tokens that the same urls have one takes part, so
    a host with many parts is no larger an item set than what its parts tell apart.
    """
    labelled = checkpointed(labelled.where(F.size("tokens") > 0).select("_url", "tokens", "blocked"))
    n = labelled.count()
    stands = representatives(labelled, support * n, 0.9 * n) if n else {}
    if not stands:
        return labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double")
    keep = F.array(*[F.lit(t) for t in sorted(set(stands.values()))])
    baskets = labelled.select(F.array_union(F.array_intersect("tokens", keep), F.when(F.col("blocked"), F.array(F.lit("=block"))).otherwise(F.array(F.lit("=allow")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit("=block"))) & ~F.array_contains("antecedent", "=allow"))
    found = checkpointed(found.select(F.sort_array("antecedent").alias("tokens"), "confidence", F.xxhash64(F.sort_array("antecedent")).alias("rule_id")))
    # A rule goes if fewer of its tokens give as much; rules meet the shorter ones over a token that both hold.
    short = found.select(F.explode("tokens").alias("t"), F.col("tokens").alias("s"), F.col("confidence").alias("c"))
    beaten = found.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("t")).join(short, "t").where((F.size("s") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("s", "tokens")) == 0))
    return found.join(beaten.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "tokens", "confidence")


def fired(urls: DataFrame, rules: DataFrame, few_rules: int) -> DataFrame:
    """(_url, rule_id) of distinct urls (_url, tokens) and the rules whose tokens they all have, by the inverted index."""
    index = rules.select("rule_id", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    if rules.count() <= few_rules:
        index = F.broadcast(index)
    # Tokens that no rule holds are dropped by the join, so what is shuffled by url is small.
    met = urls.select("_url", F.explode("tokens").alias("token")).distinct().join(index, "token")
    return met.groupBy("_url", "rule_id", "needed").agg(F.count("*").alias("n")).where("n = needed").select("_url", "rule_id")


def proven(rules: DataFrame, held_out: DataFrame, *, confidence: float, chance: float, few_rules: int) -> DataFrame:
    """The rules that hold on urls they weren't mined from: as confident there, and beyond what chance gives.

    Beyond chance: as many blocked urls as a rule fires on would come by the share of blocked urls alone less often than
    `chance` divided by the number of rules tested (normal approximation). Adds tested (urls it fires on) and precision.
    """
    tested = rules.count()
    n, bad = held_out.agg(F.count("*"), F.sum(F.col("blocked").cast("long"))).first()
    share = (bad or 0) / n if n else 0.0
    if not tested or not 0 < share < 1:
        return rules.limit(0).withColumns({"tested": F.lit(0).cast("long"), "precision": F.lit(0.0)})
    least = NormalDist().inv_cdf(1 - chance / tested)
    times = held_out.groupBy("_url").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"))
    sums = fired(held_out, rules, few_rules).join(times, "_url").groupBy("rule_id").agg(F.sum("n").alias("tested"), F.sum("bad").alias("bad"))
    sure = (F.col("bad") - F.col("tested") * share) >= least * F.sqrt(F.col("tested") * share * (1 - share))
    kept = sums.withColumn("precision", F.col("bad") / F.col("tested")).where(sure & (F.col("precision") >= confidence)).drop("bad")
    return rules.join(kept, "rule_id")


def learn(labelled: DataFrame, *, support: float = 0.005, confidence: float = 0.6, chance: float = 0.01, few_rules: int = 20_000) -> DataFrame:
    """Mined and proven rules from (url, blocked): two thirds of the urls, by a hash, are mined, the others test the rules."""
    rows = checkpointed(split_urls(labelled.select(F.col("url").alias("_url"), "blocked")))
    part = F.pmod(F.xxhash64("_url", F.lit(2)), F.lit(3))
    rules = checkpointed(mine(rows.where(part != 0), support=support, confidence=confidence))
    return checkpointed(proven(rules, rows.where(part == 0), confidence=confidence, chance=chance, few_rules=few_rules))


def judge(urls: DataFrame, labelled: DataFrame, url: str = "url", *, rules=RULES, support: float = 0.005, confidence: float = 0.6, chance: float = 0.01, few_rules: int = 20_000) -> DataFrame:
    """urls with host, path, rule, verdict, and mined_rules, how many mined rules fired.

    labelled: (url, blocked). The index is broadcast while the mined rules are counted and few, else joined.
    """
    given = others(urls, "host", "path", "rule", "verdict", "mined_rules")
    name, verdict = fixed_rule(rules)
    # The input's columns stay apart in a struct, so their names don't matter.
    rows = split_urls(urls.select(F.struct(*given).alias("_row"), F.col(url).alias("_url")))
    found = learn(labelled, support=support, confidence=confidence, chance=chance, few_rules=few_rules)
    counts = fired(rows, found, few_rules).groupBy("_url").agg(F.count("*").alias("_fired"))
    rows = rows.join(counts, "_url", "left")
    mined = F.coalesce(F.col("_fired"), F.lit(0).cast("long"))
    return rows.select("_row.*", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(mined > 0, "block").otherwise("allow")).alias("verdict"), mined.alias("mined_rules"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of pages whose path names a labelled document; several labels of a document: blocked if any says so."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    number = F.try_to_number(F.regexp_extract("url", r"://[^?#]*/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|\z)", 1), F.lit("9" * 18))
    served = pages.select("url", number.cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    return served.join(known, "doc_id").select("url", (F.col("bad") == 1).alias("blocked"))


def op2_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_pages(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "mined_rules")
