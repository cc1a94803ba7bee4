"""The versioned table: reads as of a version, conflicts, deletions, undo, snapshots."""

import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import versions
from corpusloom.sources.versions import Conflict, VersionedTable

DOCS = [(1, "# A\n\na\n\n# B\n\nb\n"), (2, "# C\n\nc\n\n# A\n\na\n"), (3, "# D\n\nd\n"), (2**60 + 1, "# E\n"), (2**60 + 3, None)]


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark.createDataFrame(DOCS, "doc_index long, markdown string"), f"file://{tmp_path}/t")


def now(t, version=None):
    return {r["doc_index"]: r["markdown"] for r in t.as_of(version).collect()}


def changed(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_index long, markdown string")


def test_as_of_every_version(spark, table):
    one = dict(DOCS)
    assert table.commit(changed(spark, (1, "x"), (9, "new")), 1) == 2
    assert table.delete(spark.createDataFrame([(3,), (2**60 + 1,)], "doc_index long"), 2) == 3
    assert table.commit(changed(spark, (3, "back")), 3) == 4
    two = one | {1: "x", 9: "new"}
    three = {k: v for k, v in two.items() if k not in (3, 2**60 + 1)}
    assert [now(table, v) for v in (1, 2, 3, 4)] == [one, two, three, three | {3: "back"}]
    assert now(VersionedTable(spark, table.path)) == three | {3: "back"}
    assert [(r["version"], r["kind"]) for r in table.log()] == [(1, "load"), (2, "edit"), (3, "delete"), (4, "edit")]
    with pytest.raises(ValueError, match="no version"):
        table.as_of(7)


def at_once(*writes):
    """Results, or errors, of writers that begin together."""
    out, gate = [None] * len(writes), threading.Barrier(len(writes))

    def run(k, write):
        gate.wait()
        try:
            out[k] = write()
        except Exception as e:  # noqa: BLE001
            out[k] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(writes)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    return out


def test_of_two_writers_of_a_document_one_wins(spark, table):
    got = at_once(*[lambda k=k: table.commit(changed(spark, (1, f"w{k}"), (10 + k, "own")), 1) for k in range(2)])
    assert {type(x) for x in got} == {int, Conflict}, got
    (won,), (lost,) = [x for x in got if x == 2], [x for x in got if isinstance(x, Conflict)]
    assert lost.documents == [1] and lost.version == 2 and table.latest() == won
    k = got.index(won)
    assert now(table) == dict(DOCS) | {1: f"w{k}", 10 + k: "own"}


def test_writers_of_different_documents_all_win(spark, table):
    got = at_once(*[lambda k=k: table.commit(changed(spark, (k, f"w{k}")), 1) for k in (1, 2, 3, 50)])
    assert sorted(got) == [2, 3, 4, 5]
    assert now(table) == dict(DOCS) | {k: f"w{k}" for k in (1, 2, 3, 50)}


def test_a_manifest_is_written_once(table):
    got = at_once(*[lambda k=k: table._appear(2, {"version": 2, "data": str(k), "base": 1, "kind": "edit", "undoes": None}) for k in range(8)])
    assert sorted(got) == [False] * 7 + [True]
    assert [r["data"] for r in table.log()][1:] == [str(got.index(True))]


def test_deleted_sections_come_back_by_undo(spark, table):
    parts = spark.createDataFrame([(0, 1, "# A\n\na"), (1, 2, "# A\n\na"), (2, 2, "# C\n\nc"), (3, 1, "# A\n\na"), (4, 3, "# gone"), (5, 77, "# A")], "original_order int, doc long, part string")
    version, report = versions.delete_sections(table, parts)
    assert {r["original_order"]: r["state"] for r in report.collect()} == {0: "done", 1: "done", 2: "done", 3: "claimed", 4: "stale", 5: "missing"}
    gone = dict(DOCS) | {1: "\n\n# B\n\nb\n", 2: "\n"}
    assert version == 2 and now(table) == gone
    table.commit(changed(spark, (3, "later")), 2)
    assert table.undo(2) == 4 and now(table) == dict(DOCS) | {3: "later"}
    assert table.log()[-1]["undoes"] == 2
    assert versions.delete_sections(table, parts.where("doc = 77"))[0] is None


def test_undo_is_refused_after_a_later_change_and_brings_back_the_deleted(spark, table):
    table.commit(changed(spark, (1, "x"), (8, "new")), 1)
    table.commit(changed(spark, (1, "y")), 2)
    with pytest.raises(Conflict) as e:
        table.undo(2)
    assert e.value.documents == [1]
    assert table.undo(3) == 4 and now(table)[1] == "x"
    table.delete(changed(spark, (8, None)), 4)
    table.undo(5)
    assert now(table)[8] == "new"
    with pytest.raises(ValueError, match="undone"):
        table.undo(1)


def test_pairs_are_rewritten_on_both_sides_or_none(spark, table):
    e = [(0, 1, 0, "# A\n\na", "# A2", 2, 1, "# A\n\na", "# A3"), (1, 1, 1, "# B\n\nb", "# no", 3, 0, "# not there", "# no")]
    edits = spark.createDataFrame(e, "original_order int, a_doc long, a_sec int, a_text string, new_a string, b_doc long, b_sec int, b_text string, new_b string")
    version, report = versions.rewrite_pairs(table, edits)
    assert {r["original_order"]: r["state"] for r in report.collect()} == {0: "done", 1: "stale"}
    assert version == 2 and now(table) == dict(DOCS) | {1: "# A2\n\n# B\n\nb\n", 2: "# C\n\nc\n\n# A3\n"}


def test_snapshot_keeps_versions_and_conflicts(spark, table):
    table.commit(changed(spark, (1, "x")), 1)
    assert table.snapshot() == 3
    table.commit(changed(spark, (2, "y")), 2)
    want = dict(DOCS) | {1: "x", 2: "y"}
    assert now(table) == want and now(table, 2) == dict(DOCS) | {1: "x"}
    assert {r["doc_index"]: r["version"] for r in table.as_of().collect()} == {k: 2 if k == 1 else 4 if k == 2 else 1 for k in want}
    with pytest.raises(Conflict):
        table.commit(changed(spark, (1, "z")), 1)
    assert table.as_of().select(F.max("version")).first()[0] == 4
