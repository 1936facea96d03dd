"""Landed files to a store with a report, and the catalogue of wide tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from varlex.plans.landed import Landing, StreamReport, first_usable, ingest_landed
from varlex.sources import bucket_store, wide_tables
from varlex.specs import HASH_SPECS, MODEL_SPECS
from varlex.streaming.landing import landing_stream, upsert_stream


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_first_place_with_enough_text(spark, tmp_path):
    short = write(tmp_path / "short", "a.csv", "a,b\n1,2\n")
    long = write(tmp_path / "long", "a.csv", "b,a\nsome text,x\n")
    later = write(tmp_path / "later", "a.csv", "a,b\n" + "much more text,y\n" * 9)
    landing = Landing((str(tmp_path / "absent"), short, long, later), "csv", min_chars=5)
    assert [(r["a"], r["b"]) for r in first_usable(spark, landing, ["a", "b"]).collect()] == [("x", "some text")]
    assert first_usable(spark, Landing((str(tmp_path / "absent"),)), ["a"]) is None
    assert first_usable(spark, Landing((short,), min_chars=50), ["a"]).count() == 0


def test_ingest_reports_every_registry_and_repeats_nothing(spark, tmp_path):
    items = write(tmp_path / "items", "a.csv", "label,itemid,fluid,category\nHeart,1,Blood,Lab\n,2,,\nHeart again,1,Blood,Lab\nx,1,2,3,4\n")
    codes = write(tmp_path / "codes", "a.json", '{"value": [{"IndicatorCode": "W1", "IndicatorName": "Life"}, 7]}')
    landings = {"mimic_iv": Landing((items,), "csv"), "who": Landing((codes,), key="value")}
    store, report = str(tmp_path / "store"), str(tmp_path / "report")
    keys = ["mimic_iv", "who", "nhanes", "usaid"]
    told = {r["source_key"]: r for r in ingest_landed(spark, landings, HASH_SPECS, store, report, "one", keys, buckets=4).collect()}
    assert {k: (r["status"], r["n_landed"], r["n_bad"], r["n_rows"]) for k, r in told.items()} == {
        "mimic_iv": ("ok", 3, 1, 2), "who": ("ok", 1, 1, 1), "nhanes": ("seeded", 0, 0, 3), "usaid": ("failed", 0, 0, 0),
    }
    assert "usaid" in told["usaid"]["error"]
    rows = {r["id"]: r["document"] for r in bucket_store.read_store(spark, store).collect()}
    assert len(rows) == 6
    assert rows["MIMIC_ITEM_1"] == "Source: MIMIC-IV | ItemID: 1 | Label: Heart | Fluid: Blood | Category: Lab"
    assert rows["WHO_GHO_W1"] == "Source: WHO GHO | Indicator Code: W1 | Name: Life"
    number = bucket_store.manifest(spark, store).number
    again = ingest_landed(spark, landings, HASH_SPECS, store, report, "one", keys)
    assert bucket_store.manifest(spark, store).number == number
    assert again.count() == 8  # two runs of the batch


def test_specs_whose_ids_are_the_key_have_unique_ids():
    assert all(spec.unique_ids for spec in HASH_SPECS.values())
    who = HASH_SPECS["who"]
    assert not replace(who, dedup=None).unique_ids
    assert not replace(who, id="{Code}_{Name}").unique_ids and not replace(who, id="{Name}").unique_ids
    assert not replace(who, id="{Code[:3]}").unique_ids


def test_stream_batches_are_reported(spark, tmp_path):
    landing, store, checkpoint, report = (str(tmp_path / n) for n in ("landing", "store", "checkpoint", "report"))
    listener = StreamReport(spark, report, "nih_allofus")
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame([("q1",), ("q2",)], "question_text string").coalesce(1).write.json(landing)
        stream = landing_stream(spark, landing, "question_text string", "json")
        upsert_stream(stream, MODEL_SPECS["nih_allofus"], store, checkpoint).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    told = spark.read.parquet(report).collect()
    assert told and {r["source_key"] for r in told} == {"nih_allofus"} and {r["status"] for r in told} == {"ok"}


@pytest.fixture
def wide(spark, tmp_path):
    path = str(tmp_path / "wide")
    for table, columns in (("A", {"x": "int", "y": "double"}), ("A", {"x": "double"}), ("B", {"y": "string", "z": "double"}), ("C", {"z": "int"})):
        rows = spark.range(5).select(
            F.col("id").alias("SEQN"), *[F.when(F.col("id") != 3, F.col("id") + 1).cast(kind).alias(c) for c, kind in columns.items()],
            F.lit(table).alias("table_id"),
        )
        rows.coalesce(1).write.mode("append").partitionBy("table_id").parquet(path)
    catalogue = str(tmp_path / "catalogue")
    wide_tables.write_catalogue(spark, path, catalogue)
    return wide_tables.read_catalogue(spark, catalogue)


def scanned(spark, catalogue, *pairs):
    targets = spark.createDataFrame(pairs, "wide_table string, variable_id string")
    return wide_tables.scan_targets(spark, catalogue, targets)


def test_only_files_and_columns_with_a_target_are_opened(spark, wide):
    assert wide.count() == 3 + 2 + 3 + 2
    found = scanned(spark, wide, ("A", "x"), ("B", "z"), ("B", "nothing"), ("A", "x"))
    got = sorted((r["table_id"], r["variable_id"], r["SEQN"], r["value"]) for r in found.collect())
    assert got == sorted([("A", "x", k, k + 1.0) for k in (0, 1, 2, 4)] * 2 + [("B", "z", k, k + 1.0) for k in (0, 1, 2, 4)])
    assert len(found.inputFiles()) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "y:" not in plan.replace("SEQN", "")
    one = scanned(spark, wide, ("C", "z"))
    assert len(one.inputFiles()) == 1 and one.count() == 4
    assert scanned(spark, wide, ("C", "x")).count() == 0
    assert {r["value"] for r in scanned(spark, wide, ("B", "y")).collect()} == {1.0, 2.0, 3.0, 5.0}
