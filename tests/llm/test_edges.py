"""Every operator over nulls, empty and very long texts, repeated rows, extra columns with clashing names, and an empty table."""

import pytest
from pyspark.sql import functions as F

from factorloom.llm import bpe, ctw, decontaminate, langid, line_dedup, near_dedup, quality_gam, quality_rules, substring_dedup, url_rules
from factorloom.llm.features import features

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, of string, n_words string, kept int, items string, row string, n int, label string, word string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one two", "en", "a"), (5, LONG, "de", "b"), (5, LONG, "de", "b"), (6, LONG, "de", "b"),
    (7, "The quick brown fox jumps over the lazy dog while the cat looks on.", "en", "a"), (7, "Other words of the same id stand here, and there are some more of them.", "en", "a"),
    (None, "A row without an id has words as well, and they are not few at all.", "en", "a"), (8, "<|endoftext|> İΣ café \U0001f600\x00", "es", "a"),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    rows = [(i, t, lang, source, len(t or ""), 1, "x", "y", 0, "z", "r", 1, "l", "w") for i, t, lang, source in ROWS]
    return spark.createDataFrame(rows if request.param == "rows" else [], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def n(docs):
    return docs.count()


def test_ctw(docs, n):
    rows = ctw.score(docs, F.lit(True)).collect()
    assert len(rows) == n and all(r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} <= {1}
    untrained = ctw.score(docs, F.lit(None).cast("boolean")).collect()
    assert len(untrained) == n and all(r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_near_dedup(docs, n):
    rows = near_dedup.dedup(docs).collect()
    assert len(rows) == n
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} <= {5}
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_decontaminate(spark, docs, n):
    items = spark.createDataFrame([("a", "brown fox"), ("b", "brown fox"), ("c", None), ("d", ""), ("e", " ".join(LONG.split()[100:130]))], "item_id string, text string")
    rows = decontaminate.decontaminate(docs, items).collect()
    assert len(rows) == n and all(r.contaminated == (r.n_hit > 0) for r in rows)
    if n:
        assert sorted((r.n_hit, tuple(r["items"])) for r in rows if r.doc_id == 7) == [(0, ()), (2, ("a", "b"))]
        assert {(r.n_hit, tuple(r["items"])) for r in rows if r.doc_id in (5, 6)} == {(30, ("e",))}
    assert decontaminate.clean(docs, items).count() == (n and n - 4)
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").isEmpty()


def test_quality_rules(docs, n):
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == n and not any(r.kept and r.base_failed for r in rows)
    assert all(r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    own = {"mean_word": 99.0, "symbol_share": 98.0, "_lang": 97.0, "_source": 96.0, "_row": 95.0}
    clash = quality_rules.judge(docs.withColumns({c: F.lit(v) for c, v in own.items()})).collect()
    assert len(clash) == n and all(r[c] == v for r in clash for c, v in own.items())


def test_substring_dedup(docs, n):
    rows = substring_dedup.remove_repeats(docs).collect()
    assert len(rows) == n
    assert {(r.n_words, r.n_removed, r.kept) for r in rows if r.doc_id in (5, 6)} <= {(30_000, 30_000, "")}
    assert all(r.n_removed == 0 for r in rows if r.doc_id not in (5, 6))


def test_bpe(docs, n):
    rows = bpe.encode(docs, bpe.vocabulary_path()).collect()
    assert len(rows) == n and all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.id == 1 and r["items"] == "z" for r in rows)
    clash = bpe.encode(docs.withColumns({"IDS": F.lit(7), "Decoded": F.lit("q")}), bpe.vocabulary_path())
    assert [c for c in clash.columns if c.lower() in ("ids", "decoded")] == ["ids", "decoded"]
    assert sorted(map(str, clash.select("doc_id", "ids", "decoded").collect())) == sorted(str(r) for r in bpe.encode(docs, bpe.vocabulary_path()).select("doc_id", "ids", "decoded").collect())


def test_quality_gam(spark, docs, n):
    described = features(docs)
    for labels in ([], [(7, 1), (5, 0), (6, None), (None, 1), (4, 3)], [(7, 1)]):
        rows = quality_gam.score(described, quality_gam.learn(described, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)


def test_languages_in_shards(spark):
    """Models of few languages each say what one model says; texts whose only alphanumerics are no letters get und."""
    words = {"aa": "bla bli blo blu", "bb": "kras kres kris kros", "cc": "zim zam zom zum"}
    rows = [(i, " ".join([words[lang]] * (1 + i % 3)), lang) for i, lang in enumerate([*words] * 20)] + [(90, "\u00b2 \u00bd 12", None), (None, "bla blo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (sorted(map(str, langid.identify(docs, langid.learn(docs, shard=k)).select("doc_id", "lang_pred", "rejected").collect())) for k in (500, 1))
    assert one == many and "Row(doc_id=90, lang_pred='und', rejected=True)" in one
    assert all(r.lang_pred == rows[r.doc_id][2] for r in langid.identify(docs, langid.learn(docs)).collect() if r.doc_id is not None and r.doc_id < 60)


def test_langid(docs, n):
    for train in (docs, docs.limit(0)):
        rows = langid.identify(docs, langid.learn(train)).collect()
        assert len(rows) == n and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))


def test_line_dedup(docs, n):
    rows = line_dedup.drop_lines(docs, least_docs=2).collect()
    assert len(rows) == n and all(r.n_dropped == 0 for r in rows)
    assert all(r.id == 1 and r.word == "w" for r in rows)
    clash = line_dedup.drop_lines(docs.withColumn("N_LINES", F.lit(9)), least_docs=1)
    assert [c for c in clash.columns if c.lower() == "n_lines"] == ["n_lines"]
    assert {(r.n_lines, r.text) for r in clash.collect() if r.doc_id in (5, 6)} <= {(1, "")}


def test_url_rules(spark):
    schema = "page_id long, url string, host string, tokens string, n int"
    rows = [(1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, "no scheme", "x", "y", 1), (4, "http://", "x", "y", 1), (4, "http://", "x", "y", 1), (None, "HTTP://Sub.Example.COM/en/7?q", "x", "y", 1)]
    labelled = spark.createDataFrame([], "url string, blocked boolean")
    out = url_rules.judge(spark.createDataFrame(rows, schema), labelled).collect()
    assert len(out) == 6 and all((r.host, r.path, r.rule, r.verdict) == ("", "", None, "allow") for r in out if r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in out if not r.page_id] == [("sub.example.com", "/en/7", "example.com/en/7", "allow")]
    assert all((r.tokens, r.n) == ("y", 1) for r in out)
    long = [(7, "https://h.org/" + "/".join(f"p{i}" for i in range(20_000)) + "?" + "&".join(f"k{i}=v" for i in range(5_000)), "x", "y", 1)] * 2
    assert [r.verdict for r in url_rules.judge(spark.createDataFrame(long, schema), labelled.sparkSession.createDataFrame([(long[0][1], True), ("http://a.b/c", False)], "url string, blocked boolean")).collect()] == ["allow"] * 2
    assert url_rules.judge(spark.createDataFrame([], schema), labelled).count() == 0


def test_pipeline_stages(spark, small):
    """Each stage over nulls, repeats, clashing names and an empty table; all but the last give the columns they got."""
    import corpus_pipeline as P

    plain = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _row int, n_hit int, kept int, _key int"
    rows = [(i, t, lang, source, len(t or ""), 1, 2, 3, 4, 5) for i, t, lang, source in ROWS]
    for given in (rows, []):
        docs = spark.createDataFrame(given, plain)
        for label, stage in P.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns, label
            found = out.collect()
            assert len(found) <= len(given) and all((r["_gone"], r["_row"], r.n_hit, r.kept, r["_key"]) == (1, 2, 3, 4, 5) for r in found), label
        assert P.STAGES[-1][1](spark, docs, small).count() == len(given)
