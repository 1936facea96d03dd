"""Sinks, store upkeep, run report and the file stream."""

import json

import pytest
from pyspark.sql import functions as F

from varlex import fixed
from varlex.operators import report
from varlex.operators.ordering import ORD
from varlex.plans import ingest
from varlex.plans.ingest import build_if_missing, embed_corpus, harmonise, run_ingest
from varlex.session import fresh_path, shared_dir
from varlex.sources import sinks
from varlex.sources.stores import scan_vector_store
from varlex.specs import HASH_SPECS, MODEL_SPECS
from varlex.streaming.landing import landing_stream, upsert_stream

ROW = f"id string, source string, document string, {ORD} long"


def updates(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ROW)
    return df.withColumns({
        "indicator_id": F.col("id"), "short_name": F.lit("n"), "vector": F.array(F.lit(1.0).cast("float")),
        "metadata": F.create_map(F.lit("source"), F.col("source"))})


def content(spark, path):
    return sorted((r["id"], r["source"], r["document"]) for r in scan_vector_store(spark, path).collect())


def test_upsert_replaces_inserts_and_keeps(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.ensure_store(spark, path)
    sinks.ensure_store(spark, path)
    assert content(spark, path) == []
    sinks.upsert_by_id(spark, path, updates(spark, [("a", "1", "old"), ("b", "2", "x"), ("n", None, "none")]))
    assert content(spark, path) == [("a", "1", "old"), ("b", "2", "x"), ("n", None, "none")]
    batch = updates(spark, [("a", "1", "first"), ("c", "1", "new"), ("a", "1", "last")])
    for _ in range(2):  # twice is the same as once
        sinks.upsert_by_id(spark, path, batch)
        assert content(spark, path) == [("a", "1", "last"), ("b", "2", "x"), ("c", "1", "new"), ("n", None, "none")]
    sinks.upsert_by_id(spark, path, updates(spark, [("n", None, "again")]))
    assert content(spark, path)[-1] == ("n", None, "again") and len(content(spark, path)) == 4


def test_untouched_sources_are_neither_read_nor_rewritten(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.upsert_by_id(spark, path, updates(spark, [(f"{s}{i}", s, "x") for s in "pq" for i in range(20)]))
    before = {f.name for f in (tmp_path / "store" / "source=q").iterdir()}
    sinks.upsert_by_id(spark, path, updates(spark, [("p1", "p", "y")]))
    assert {f.name for f in (tmp_path / "store" / "source=q").iterdir()} == before
    touched = sinks.touched_sources(updates(spark, [("p1", "p", "y")]))
    plan = scan_vector_store(spark, path).where(touched)._jdf.queryExecution().executedPlan().toString()
    assert "source" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(content(spark, path)) == 40


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y'), ("b", None)], "k string, v string")
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.options(header=True, escape='"').csv(str(tmp_path / "csv")).collect())) == [
        ("a", 'say "x", y'), ("b", None)]
    sinks.export_json_records(df, str(tmp_path / "json"))
    lines = [line for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert {"k": "b", "v": None} in [json.loads(line) for line in lines]


def test_embed_corpus_encodes_only_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    seen = str(tmp_path / "seen")

    def factory():
        import os
        import uuid

        os.makedirs(seen, exist_ok=True)

        def encode(texts):
            with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return [[float(len(t))] for t in texts]

        return encode

    def encoded():
        import pathlib

        return sorted(t for f in pathlib.Path(seen).glob("*") for t in f.read_text().splitlines())

    rows = updates(spark, [("a", "s", "one"), ("b", "s", "two")]).drop("vector")
    embed_corpus(spark, rows, path, factory)
    assert encoded() == ["one", "two"]
    again = updates(spark, [("a", "s", "one"), ("b", "s", "three"), ("c", "s", "four")]).drop("vector")
    embed_corpus(spark, again, path, factory, sources=["s"])
    assert encoded() == ["four", "one", "three", "two"]
    assert content(spark, path) == [("a", "s", "one"), ("b", "s", "three"), ("c", "s", "four")]


def test_only_the_last_row_of_an_id_is_encoded_and_vectors_are_not_staged(spark, tmp_path, monkeypatch):
    path, staged = str(tmp_path / "store"), []
    monkeypatch.setattr(ingest, "discard", lambda s, p: staged.append(s.read.parquet(p)))
    rows = updates(spark, [("a", "s", "old"), ("b", "s", "x"), ("a", "s", "one"), ("n", None, "none")]).drop("vector")
    embed_corpus(spark, rows, path)
    assert "vector" not in staged[0].columns and staged[0].count() == 3
    assert content(spark, path) == [("a", "s", "one"), ("b", "s", "x"), ("n", None, "none")]
    assert {len(r["vector"]) for r in scan_vector_store(spark, path).collect()} == {fixed.EMBED_DIM}
    # The last row of "a" is what the store has, so neither of its rows changes anything.
    embed_corpus(spark, updates(spark, [("a", "s", "two"), ("c", "s", "y"), ("a", "s", "one")]).drop("vector"), path)
    assert [r["id"] for r in staged[1].collect()] == ["c"]
    assert content(spark, path) == [("a", "s", "one"), ("b", "s", "x"), ("c", "s", "y"), ("n", None, "none")]


def test_rows_of_few_sources_are_staged_as_they_are_encoded(spark, tmp_path, monkeypatch):
    """No shuffle of all rows beside the store; files of bounded rows, a task for each; vectors are packed by zstd."""
    import pyarrow.parquet as pq

    path, plain, staged = str(tmp_path / "store"), str(tmp_path / "plain"), []
    given = [(f"r{k}", (None, "1", "01", "s t/=")[k % 4], f"text {k}") for k in range(400)]
    rows = updates(spark, given).drop("vector").coalesce(1)
    embed_corpus(spark, rows, plain)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    monkeypatch.setattr(ingest, "VECTOR_ROWS", 30)
    monkeypatch.setattr(ingest, "discard", lambda s, p: staged.append(p))
    with monkeypatch.context() as m:
        m.setattr(sinks, "dealt_for_vectors", lambda *a: pytest.fail("rows are moved again"))
        embed_corpus(spark, rows, path, sources=["1", "01", "s t/="])
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    kept, found = (scan_vector_store(spark, p) for p in (plain, path))
    assert content(spark, path) == content(spark, plain) and len(content(spark, path)) == 400
    assert found.drop("metadata").exceptAll(kept.drop("metadata")).count() == 0
    metas = [pq.ParquetFile(f).metadata for f in (tmp_path / "store").glob("source=*/*.parquet")]
    assert max(m.num_rows for m in metas) <= 30 and len(metas) <= 4 * 5 * 8
    assert {m.row_group(0).column(k).compression for m in metas for k in range(m.num_columns)} == {"ZSTD"}
    assert "vector" not in spark.read.parquet(staged[0]).columns
    # A second batch into the same store, with a source that wasn't named.
    again = [("r0", None, "new"), ("r1", "1", "text 1"), ("x", "another", "x")]
    embed_corpus(spark, updates(spark, again).drop("vector"), path, sources=["1", "01"])
    wanted = {**{r[0]: r for r in given}, **{r[0]: r for r in again}}
    assert sorted(map(str, content(spark, path))) == sorted(map(str, wanted.values()))


def test_a_batch_never_loses_rows_of_sources_that_are_not_named(spark, tmp_path):
    path = str(tmp_path / "store")
    embed_corpus(spark, updates(spark, [("p1", "p", "a"), ("q1", "q", "b"), ("q2", "q", "c")]).drop("vector"), path)
    embed_corpus(spark, updates(spark, [("p1", "p", "x"), ("q1", "q", "y")]).drop("vector"), path, sources=["p"])
    assert content(spark, path) == [("p1", "p", "x"), ("q1", "q", "y"), ("q2", "q", "c")]


def test_rows_without_input_order_are_refused(spark, tmp_path):
    rows = updates(spark, [("p1", "p", "a")]).drop("vector", ORD)
    with pytest.raises(ValueError, match="order"):
        embed_corpus(spark, rows, str(tmp_path / "store"))


def test_build_if_missing(spark, tmp_path):
    path = str(tmp_path / "store")
    build = lambda: sinks.upsert_by_id(spark, path, updates(spark, [("a", "1", "x")]))
    assert build_if_missing(spark, path, build) is True
    assert build_if_missing(spark, path, build) is False


def test_run_report_isolates_failures(spark, tmp_path):
    path = str(tmp_path / "store")

    def broken():
        raise RuntimeError("cannot read")

    readers = {"who": broken}
    result = run_ingest(spark, readers, HASH_SPECS, path)
    got = {r["source_key"]: r for r in result.collect()}
    assert [r["source_key"] for r in result.collect()] == list(HASH_SPECS)
    assert got["who"]["status"] == "failed" and "cannot read" in got["who"]["error"]
    assert got["usaid"]["status"] == "failed"  # nothing landed, policy: raise
    assert {k: r["n_rows"] for k, r in got.items() if r["status"] == "ok"} == {
        "mimic_iv": 3, "nih_allofus": 3, "nhanes": 3, "uk_biobank": 3}
    assert scan_vector_store(spark, path).count() == 12
    skipped = run_ingest(spark, {}, MODEL_SPECS, path, ["uk_biobank"]).first()
    assert skipped["status"] == "ok" and skipped["n_rows"] == 0


def test_reports(spark):
    df = spark.createDataFrame([("a", "s"), ("a", "s"), ("b", None)], "id string, source string")
    assert report.count_records(df).first()[0] == 3
    assert [r[0] for r in report.distinct_sources(df).collect()] == ["s", "unknown"]
    assert report.count_sources(df).first()[0] == 2
    with_meta = df.withColumn("metadata", F.when(F.col("source").isNotNull(), F.create_map(F.lit("k"), F.lit("v"))))
    assert [r[0] for r in report.distinct_sources(with_meta).collect()] == ["s"]
    counts = {r["source"]: (r["n_rows"], r["n_ids"]) for r in report.ingest_counts(df).collect()}
    assert counts == {"s": (2, 1), None: (1, 1)}


def test_stream_upserts_new_files_once(spark, tmp_path):
    landing, store, check = (str(tmp_path / n) for n in ("landing", "store", "check"))
    schema = "itemid string, label string, fluid string, category string"
    spec = HASH_SPECS["mimic_iv"]

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = landing_stream(spark, landing, spark.createDataFrame([], schema).schema)
        upsert_stream(stream, spec, store, check).awaitTermination()

    land([("1", "one", "Blood", "Chem"), ("1", "copy", "Blood", "Chem"), ("2", None, None, None)])
    run()
    assert [i for i, _, _ in content(spark, store)] == ["MIMIC_ITEM_1", "MIMIC_ITEM_2"]
    land([("2", "two", "Blood", "Chem"), ("3", "three", "Blood", "Chem")])
    run()
    run()
    documents = {i: d for i, _, d in content(spark, store)}
    assert len(documents) == 3 and "Label: one" in documents["MIMIC_ITEM_1"] and "Label: two" in documents["MIMIC_ITEM_2"]


def test_shared_folder_is_the_sessions(spark):
    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured.rstrip("/")


def test_harmonised_order_of_sources(spark):
    with pytest.raises(ValueError, match="unknown registries"):
        harmonise(spark, {}, HASH_SPECS, ["mimic_iv", "other"])
