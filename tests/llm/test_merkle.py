"""The manifest against a plain recursive tree, the log against appending node by node."""

import hashlib
import zlib

import pytest

from factorloom.llm import merkle
from factorloom.llm.common import table

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([H(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def siblings(tree, i):
    """Level by level: the nodes before and after in the run."""
    for level in tree[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted by text."""
    leaf = lambda r, t: H(*map(value, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([leaf(r, r[1]) for r in groups[x]]) for x in langs]
    top = levels([t[-1][0] for t in trees]) if trees else []
    lowered = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    out = []
    for g, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            path = [*siblings(trees[g], i), *siblings(top, g)]
            told = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, lowered(r[1]) if told else r[1])
            for before, after in path:
                h = H(*before, h, *after)
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], top[-1][0], H(*[x for b, a in path for x in b + a]), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 513, 600])
def test_log(n):
    """Nodes in completion order, at the places of the closed form."""
    leaves = [H(str(i)) for i in range(n)]
    tree = levels(leaves)
    height = merkle.height_of(n)
    assert height == len(tree) - 1
    log = merkle.appended(leaves, height)
    assert len(log) == sum(map(len, tree)) and log[-1] == tree[-1][0]
    for level, nodes in enumerate(tree):
        assert [log[merkle.place(level, i, n, height)] for i in range(len(nodes))] == nodes
    for i in {0, n // 2, n - 1}:
        assert [(s["before"], s["after"]) for s in merkle.path_of(log, i, n, height)] == [("".join(b), "".join(a)) for b, a in siblings(tree, i)]


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string, ROOT int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op13_merkle(spark, str(tmp_path)).collect()), key=str)


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, small, "documents").collect()]
    assert sorted(map(tuple, merkle.op13_merkle(spark, small).collect()), key=str) == brute(rows)


def test_many_tiers_and_groups(spark, tmp_path, monkeypatch):
    """Segments of eight leaves, so that there are several tiers; more groups than a run; a hot group."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, f"Text {i}", "en" if i % 3 else f"l{i % 33}", "s", i) for i in range(700)]
    assert run(spark, [(*r, "x", 1) for r in rows], tmp_path) == brute(rows)


def test_edges(spark, tmp_path):
    long = "LONG word " * 40_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (None, "No Id", "en", "a", 5), (None, None, None, None, None), (5, "Twice", "de", None, 1), (5, "Twice", "de", None, 1), (5, "Once", "de", None, 1), (6, "É <|x|> \u0000", "\U0001f600", "b", 3), (9, "A", "￿", "b", 3)]
    assert run(spark, [(*r, "x", 1) for r in rows], tmp_path) == brute(rows)
    assert run(spark, [], tmp_path / "none") == []


def test_names_and_log(spark):
    docs = spark.createDataFrame([(i, "en" if i < 530 else None, "kept", 7) for i in range(540)], "id long, g string, row string, Leaf int")
    out = merkle.manifest(docs, ["id", "g"], "g", "id", keep=["id", "row", "Leaf"])
    assert out.columns == ["id", "row", *merkle.OUTPUT] and out.where("verified and row = 'kept'").count() == 540
    ranked = merkle.ranked(docs.select(docs.g.alias("_by"), docs.id.alias("_order"), merkle.leaf_digest([docs.id]).alias("leaf"), merkle.F.struct("id").alias("row")))
    log = merkle.log_of(merkle.tiers_of(ranked)).collect()
    for group, ids in (("en", range(530)), (None, range(530, 540))):
        tree = levels([H(value(i)) for i in ids])
        nodes = sorted((r.position, r.level, r.node) for r in log if r["_by"] == group)
        assert [p for p, _, _ in nodes] == list(range(sum(map(len, tree))))
        assert nodes[-1][2] == tree[-1][0] and [x for _, level, x in nodes if level == 1] == tree[1]
