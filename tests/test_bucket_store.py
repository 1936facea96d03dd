"""Snapshots, conflicts and replays of the bucket store."""

import pytest
from pyspark.sql import functions as F

from varlex.operators.ordering import ORD
from varlex.session import fresh_path
from varlex.sources import bucket_store as B


def batch(spark, items, source=lambda k: f"s{k % 3}" if k % 4 else None):
    rows = [(f"r{k}", None, "n", text, [1.0], {"k": "v"}, source(k), place) for place, (k, text) in enumerate(items)]
    return spark.createDataFrame(
        rows, f"id string, indicator_id string, short_name string, document string, vector array<float>, "
        f"metadata map<string,string>, source string, {ORD} long"
    )


def texts(df):
    return {r["id"]: (r["source"], r["document"]) for r in df.collect()}


@pytest.fixture
def path(spark):
    path = fresh_path(spark, "test-buckets")
    B.upsert(spark, path, batch(spark, [(k, f"text {k}") for k in range(200)]), "first", buckets=8)
    return path


def test_upserts_replace_whole_rows_and_the_last_wins(spark, path):
    B.upsert(spark, path, batch(spark, [(3, "a"), (500, "new"), (3, "b"), (7, None)]), "second")
    found = texts(B.read_store(spark, path))
    assert len(found) == 201
    assert found["r3"] == ("s0", "b") and found["r500"] == (None, "new") and found["r7"] == ("s1", None)
    assert found["r4"] == (None, "text 4")
    assert texts(B.read_store(spark, path, number=0))["r3"] == ("s0", "text 3")
    assert set(texts(B.read_store(spark, path, sources=["s1"]))) == {k for k, v in found.items() if v[0] == "s1"}
    assert {v[0] for v in texts(B.read_store(spark, path, sources=[None])).values()} == {None}


def test_one_row_writes_one_bucket(spark, path):
    B.upsert(spark, path, batch(spark, [(5, "changed")]), "one")
    last = B.history(spark, path).orderBy(F.desc("number")).first()
    assert (last["written"], last["rows"], last["batch"]) == (1, 200, "one")


def test_a_replayed_batch_changes_nothing(spark, path):
    rows = batch(spark, [(5, "changed")])
    one = B.upsert(spark, path, rows, "one")
    B.upsert(spark, path, batch(spark, [(5, "again")]), "two")
    assert B.upsert(spark, path, rows, "one").number == one.number + 1
    assert texts(B.read_store(spark, path))["r5"][1] == "again"


def test_a_commit_without_its_mark_is_not_applied_again(spark, path):
    rows = batch(spark, [(5, "changed")])
    B.upsert(spark, path, rows, "one")
    B._Folder(spark, path).remove(B._mark("one"))
    assert B.upsert(spark, path, rows, "one").number == 1


def test_the_second_of_two_writers_conflicts(spark, path, monkeypatch):
    with pytest.raises(B.StoreConflict):
        B.upsert(spark, path, batch(spark, [(1, "x")]), "late", based_on=-1)
    before = B.manifest(spark, path)
    B.upsert(spark, path, batch(spark, [(1, "x")]), "other")
    whole = B.manifest
    monkeypatch.setattr(B, "manifest", lambda *a: before)
    with pytest.raises(B.StoreConflict):
        B.upsert(spark, path, batch(spark, [(1, "y")]), "late")
    monkeypatch.setattr(B, "manifest", whole)
    assert texts(B.read_store(spark, path))["r1"][1] == "x"
    assert len(B._Folder(spark, path).names("data")) == 2  # the loser left no rows


def test_changed_documents_read_no_documents(spark, path):
    rows = batch(spark, [(3, "text 3"), (4, "other"), (900, "new"), (6, None)])
    changed = B.changed_documents(spark, path, rows)
    assert {r["id"] for r in changed.collect()} == {"r4", "r900", "r6"}
    plan = changed._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line or "ReadSchema" in line]
    assert scans and not any("document:" in line for line in scans)


def test_embedding_only_what_changed(spark, path):
    B.embed_batch(spark, batch(spark, [(3, "text 3"), (4, "other")]).drop("vector"), path, "embedded")
    sizes = {r["id"]: len(r["vector"]) for r in B.read_store(spark, path).collect()}
    assert sizes["r4"] == 384 and sizes["r3"] == 1
    assert B.history(spark, path).agg(F.max("number")).first()[0] == 1


def test_batches_are_staged_once_for_each_id_and_without_vectors(spark, path, monkeypatch):
    staged = []
    monkeypatch.setattr(B, "discard", lambda s, p: staged.append(s.read.parquet(p)))
    items = [(3, "a"), (4, None), (500, "new"), (5, "x"), (3, "b"), (5, "text 5")]
    B.embed_batch(spark, batch(spark, items).drop("vector"), path, "staged")
    # The last row of r5 is what the store has.
    assert sorted(r["id"] for r in staged[0].collect()) == ["r3", "r4", "r500"] and "vector" not in staged[0].columns
    stored = B.read_store(spark, path)
    assert stored.count() == 201 and {f.name for f in stored.schema} == set(B.SCHEMA.names)
    found = texts(stored)
    assert (found["r3"][1], found["r4"][1], found["r5"][1], found["r500"][1]) == ("b", None, "text 5", "new")


def test_empty_batches_and_stores(spark):
    path = fresh_path(spark, "test-buckets")
    assert B.read_store(spark, path).count() == 0
    B.upsert(spark, path, batch(spark, []), "nothing")
    assert B.read_store(spark, path).count() == 0 and B.manifest(spark, path).number == 0


def test_expired_versions_go(spark, path):
    for k in range(3):
        B.upsert(spark, path, batch(spark, [(5, f"v{k}")]), f"batch {k}")
    held = texts(B.read_store(spark, path))
    assert B.expire(spark, path, keep=1) == 2
    assert texts(B.read_store(spark, path)) == held
    assert B.history(spark, path).count() == 1
