from datetime import datetime

from quillmesh.operators.snapshots import snapshot_changes

SNAP = "seq long, import_id long, source_key string, external_id string, content_hash string, import_id2 int"
IMP = "id long, source_key string, started_at timestamp, finished_at timestamp, seq string"


def day(n):
    return datetime(2024, 1, n)


def run(spark, snaps, imps):
    out = snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(imps, IMP))
    return sorted(tuple(r) for r in out.collect())


IMPORTS = [(1, "a", day(1), day(2), "x"), (2, "a", day(3), None, "x"), (3, "a", day(4), day(5), "x"), (4, "a", day(6), day(7), "x"), (5, "b", day(1), day(2), "x")]


def test_typed_changes_skip_broken_loads_and_keep_the_highest_seq(spark):
    snaps = [
        (1, 1, "a", " k1 ", "AA", 0), (2, 1, "a", "k2", "b", 0), (3, 1, "a", "k3", None, 0),
        (4, 2, "a", "k9", "zz", 0),
        (5, 3, "a", "k1", "aa ", 0), (6, 3, "a", "k2", "c", 0), (7, 3, "a", "k2", "d", 0), (7, 3, "a", "k2", "d", 0), (8, 3, "a", "k3", "q", 0),
        (9, 4, "a", "k1", "aa", 0), (10, 4, "a", "k4", "n", 0), (11, 4, "a", None, "n", 0),
        (12, 5, "b", "k1", "other", 0),
    ]
    assert run(spark, snaps, IMPORTS) == [(3, "k2", "updated"), (4, "k2", "removed"), (4, "k3", "removed"), (4, "k4", "added")]


def test_an_empty_import_between_two_removes_and_adds_again(spark):
    snaps = [(1, 1, "a", "k", "h", 0), (2, 4, "a", "k", "h", 0)]
    assert run(spark, snaps, IMPORTS) == [(3, "k", "removed"), (4, "k", "added")]


def test_empty_tables(spark):
    assert run(spark, [], IMPORTS) == []
    assert run(spark, [(1, 1, "a", "k", "h", 0)], []) == []
