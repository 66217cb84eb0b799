"""Commits of several writers, readers that stay with a version, and merges that leave other buckets' files alone."""

import threading

import pytest

from factorloom.sources import commits as C

SCHEMA = "k long, day date, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def content(spark, root, version=None):
    return sorted((r.k, r.v) for r in C.read(spark, root, version).collect())


def run_all(jobs):
    failed = []

    def guarded(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=guarded, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def test_put_if_absent(spark, tmp_path):
    """Of many writers of one file one succeeds, and the file is whole."""
    wins = []
    texts = [str(i) * 1000 for i in range(8)]
    assert not run_all([lambda t=t: wins.append(t) if C.put_if_absent(spark, f"{tmp_path}/log/x", t) else None for t in texts])
    assert len(wins) == 1 and (tmp_path / "log" / "x").read_text() == wins[0]
    assert {p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")} == {"x"}


def test_concurrent_publish(spark, tmp_path):
    """Each of two writers gets a version of its own, and no data are lost."""
    root = str(tmp_path / "t")
    assert not run_all([lambda i=i: C.publish(frame(spark, [(i, "x")]), root) for i in range(4)])
    assert C.versions(spark, root) == [1, 2, 3, 4]
    assert sorted(content(spark, root, v)[0][0] for v in C.versions(spark, root)) == [0, 1, 2, 3]


def test_concurrent_merge(spark, tmp_path):
    """The second of two merges starts again from what the first did."""
    root = str(tmp_path / "t")
    C.merge(frame(spark, [(i, "old") for i in range(20)]), root, ["k"], buckets=4)
    assert not run_all([lambda i=i: C.merge(frame(spark, [(i, f"new{i}"), (100 + i, "more")]), root, ["k"]) for i in range(3)])
    expected = {i: "old" for i in range(20)} | {i: f"new{i}" for i in range(3)} | {100 + i: "more" for i in range(3)}
    assert content(spark, root) == sorted(expected.items()) and C.versions(spark, root) == [1, 2, 3, 4]


def test_conflict(spark, tmp_path):
    root = str(tmp_path / "t")

    def late(before):
        C.commit(spark, root, before["version"] + 1, {}, {})  # another writer comes first, each time
        return {}, {}

    with pytest.raises(C.Conflict):
        C.committed(spark, root, late, attempts=3)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "t")
    C.merge(frame(spark, [(i, "old") for i in range(40)]), root, ["k"], buckets=8)
    before = C.commit_of(spark, root)
    assert sum(p["rows"] for p in before["parts"].values()) == 40
    assert C.merge(frame(spark, [(3, "new"), (4, "old")]), root, ["k"]) == 2
    after = C.commit_of(spark, root)
    moved = [b for b in after["parts"] if after["parts"][b] != before["parts"].get(b)]
    assert len(moved) == 1 and set(after["parts"]) == set(before["parts"])
    assert dict(content(spark, root)) == {i: "new" if i == 3 else "old" for i in range(40)}
    assert C.merge(frame(spark, [(3, "new"), (4, "old")]), root, ["k"]) == 2  # nothing is different
    assert dict(content(spark, root, 1))[3] == "old"  # a reader of the first version
    C.merge(frame(spark, []), root, ["k"], gone=frame(spark, [(3, ""), (999, "")]))
    assert 3 not in dict(content(spark, root)) and len(content(spark, root)) == 39
    with pytest.raises(ValueError, match="several rows"):
        C.merge(frame(spark, [(1, "a"), (1, "b")]), root, ["k"])


def test_nulls_are_values(spark, tmp_path):
    root = str(tmp_path / "t")
    C.merge(frame(spark, [(1, None), (2, "x")]), root, ["k"], buckets=2)
    assert C.merge(frame(spark, [(1, None)]), root, ["k"]) == 1
    assert C.merge(frame(spark, [(2, None)]), root, ["k"]) == 2 and content(spark, root) == [(1, None), (2, None)]


def test_prune(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(4):
        C.publish(frame(spark, [(i, "x")]), root)
    assert C.prune(spark, root, keep=2) == [1, 2] and C.versions(spark, root) == [3, 4]
    assert not C.commit(spark, root, 2, {}, {})  # a late writer can't take a number that was
    assert content(spark, root, 3) == [(2, "x")] and len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_sync_incremental(spark, tmp_path):
    """Within the overlap rows that the source lost go and changed ones change; before it only late keys are filled back."""
    root = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "ric string, date string, v int").selectExpr("ric", "to_date(date) as date", "v")
    C.sync(rows(("a", "2024-01-01", 1), ("a", "2024-02-01", 2), ("a", "2024-03-01", 3), ("a", "2024-03-02", 4), ("b", "2024-03-01", 5)), root, ["ric", "date"], mode="incremental", date="date", buckets=2)
    C.sync(rows(("a", "2024-01-01", 9), ("a", "2024-02-01", 9), ("a", "2024-03-02", 9), ("a", "2024-03-03", 9), ("b", "2024-01-05", 9), ("b", "2024-03-01", 5)), root, ["ric", "date"], mode="incremental", date="date", overlap_days=5)
    assert sorted((r.ric, str(r.date), r.v) for r in C.read(spark, root).collect()) == [("a", "2024-01-01", 1), ("a", "2024-02-01", 2), ("a", "2024-03-02", 9), ("a", "2024-03-03", 9), ("b", "2024-01-05", 9), ("b", "2024-03-01", 5)]


def test_large_buckets_are_shared_out(spark, tmp_path, monkeypatch):
    """A bucket of more rows than a task should write has several files, and the same rows."""
    monkeypatch.setattr(C, "ROWS_OF_TASK", 10)
    C.merge(spark.range(200).selectExpr("id", "id * 2 AS v"), str(tmp_path), ["id"], buckets=2)
    rows = C.read(spark, str(tmp_path))
    assert len(rows.inputFiles()) > 8 and sorted(map(tuple, rows.select("id", "v").collect())) == [(i, 2 * i) for i in range(200)]
