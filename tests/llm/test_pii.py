"""Base spans against Python's regular expressions, disclosure against counting sentences in plain Python."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from factorloom.llm import pii
from factorloom.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def proper(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    found = [(m.start(), no, m.end(), kind) for no, (kind, rx) in enumerate(PATTERNS.items()) for m in re.finditer(rx, text or "") if proper(kind, m[0])]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def entities(text):
    return {f"{k}:" + (re.sub("[^0-9]", "", text[s:e]) if k in ("card", "phone") else text[s:e].lower()) for k, s, e in base(text)}


def letters(text):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text or "")]


def brute(texts, threshold=0.9, support=2):
    """All spans of each text."""
    contexts = {s for t in texts if t is not None for s in re.split(r"\n|(?<=[.!?])[ \t]+", t)}
    held, terms = {}, {}
    for s in contexts:
        own = {w for _, _, w in letters(re.sub(PATTERNS["email"], " ", s)) if len(w) >= 3}
        for w in own | {w[:4] + "*" for w in own if len(w) > 4}:
            terms.setdefault(w, set()).add(s)
        for e in entities(s):
            held.setdefault(e, set()).add(s)
    n = len(contexts)

    def discloses(e, w):
        n_e, n_t, both = len(held.get(e, ())), len(terms.get(w, ())), len(held.get(e, set()) & terms.get(w, set()))
        return both >= support and n > n_e and math.log(both * n / (n_e * n_t)) / math.log(n / n_e) >= threshold

    out = []
    for t in texts:
        spans = base(t)
        for s, e, w in letters(t) if spans else []:
            inside = any(s < b and a < e for _, a, b in spans[: len(base(t))])
            if len(w) >= 3 and not inside and any(discloses(x, w) for x in entities(t)):
                spans.append(("term", s, e))
        order = [*PATTERNS, "term"]
        out.append(sorted(spans, key=lambda x: (x[1], order.index(x[0]))))
    return out


def flat(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_query_against_brute_force(spark, small):
    rows = table(spark, small, "documents").collect()
    got = {r.doc_id: r for r in pii.op12_pii(spark, small).collect()}
    assert len(got) == len(rows)
    for r, spans in zip(rows, brute([r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert g.spans == flat(spans) and g.base_sha256 == hashlib.sha256(flat(base(r.text)).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == kind for k, _, _ in base(r.text)) for kind in PATTERNS]


TEXTS = [
    "Write to Ann.Lee@mail.example.com about the Zorvath contract today.", "The Zorvath contract was signed; ann.lee@MAIL.example.com has it, and Quillon helped.",
    "Ask Quillon now: ann.lee@mail.example.com waits for the papers.", "The contract of the town is public today.", "Nobody waits for the papers of the town, and the contract was signed.",
    "Quill and Quills are words. Quilting is one too. Quilters waits.", "a@b.c+x@d.e y@z@q.com 1.2.3.4.5 256.1.1.1 0000001.02.3.4 +1 (555) 010-9999 +12 4111 1111 1111 1111-", "4111111111111111 4111-1111-1111-1112 40000000000002 \U0001f600 é@x.yy", None, "", " \n ",
    "Ann.Lee@mail.example.com has the Zorvath file.\nAnd others.",
]


def test_disclosure(spark):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, SPANS string, _id int").repartition(3)
    rows = {r.doc_id: r for r in pii.sanitise(docs, threshold=0.8).collect()}
    expected = brute(TEXTS, 0.8)
    for i, spans in enumerate(expected):
        assert [(s.kind, s.start, s.end) for s in rows[i].spans] == spans, TEXTS[i]
        assert rows[i]["_id"] == 5
    assert "term" in {k for k, _, _ in expected[0]} and not expected[3] and not expected[5]
    assert rows[0].sanitised == "Write to [EMAIL] about the  contract today." and rows[2].sanitised.startswith("Ask quil* now: [EMAIL]")
    assert rows[5].sanitised == TEXTS[5] and rows[8].sanitised is None and rows[9].sanitised == ""
    assert [c for c in pii.sanitise(docs.limit(0)).columns if c.lower() == "spans"] == ["spans"]


def test_edges(spark):
    long = " ".join(f"user{i}@host{i % 7}.org word{i}" for i in range(1500)) + " " + "a" * 4_000 + " " + "7" * 4_000 + " " + "1.2" * 2_000 + " +1" + " 5" * 30_000
    texts = [long, long, None, "", "Mail me: who@where.org."]
    docs = spark.createDataFrame([(None if i == 4 else 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    rows = pii.sanitise(docs, keep_text=False).collect()
    assert sorted(flat([(s.kind, s.start, s.end) for s in r.spans]) for r in rows) == sorted(flat(b) for b in map(base, texts))
    assert pii.sanitise(docs.limit(0)).count() == 0
    assert not [x for x in pii.sanitise(docs)._jdf.queryExecution().toString().split("\n") if "Python" in x or "Arrow" in x]
    runs = spark.createDataFrame([("a" * 100_000 + " " + "7" * 100_000 + "." + "3" * 100_000,)], "t string")  # quadratic for plain patterns
    assert runs.select(F.size(pii.base_spans(F.col("t"))).alias("n")).first().n == 0
