"""Registry specs over their own seed rows and awkward fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from varlex import fixed
from varlex.operators import harmonise as H
from varlex.operators import ordering as O
from varlex.operators.ordering import ORD
from varlex.plans.ingest import harmonise, harmonise_registry, harmonise_unified
from varlex.sources.landing import seed_rows
from varlex.specs import HASH_SPECS, MODEL_SPECS, select_specs


def store_rows(df):
    return {r["id"]: r for r in df.collect()}


def raw(spark, rows, columns):
    schema = ", ".join(f"{c} string" for c in columns) + f", {ORD} long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_seeded_registries_give_the_fixed_documents(spark):
    usaid = raw(spark, [("X", "L", "S", "D")], ["IndicatorId", "Label", "ShortName", "Definition"])
    got = store_rows(harmonise(spark, {"usaid": usaid}, HASH_SPECS))
    assert len(got) == 1 + 15
    assert got["MIMIC_ITEM_50912"]["document"] == (
        "Source: MIMIC-IV | ItemID: 50912 | Label: Creatinine | Fluid: Blood | Category: Chemistry"
    )
    assert got["UKB_FIELD_31"]["document"] == (
        "Source: UK Biobank | Field ID: 31 | Category: Baseline characteristics | Description: Sex"
    )
    model = store_rows(
        harmonise(spark, {"usaid": usaid, "who": raw(spark, [("c", "n", "EN"), ("d", "m", "FR")],
                                                     ["IndicatorCode", "IndicatorName", "Language"])}, MODEL_SPECS)
    )
    assert model["mimic_220045"]["document"] == (
        "Source: MIMIC-IV. Item ID: 220045. Label: Heart Rate. Category: Routine Vital Signs. Unit: bpm"
    )
    assert model["allofus_PM_001"]["metadata"] == {
        "source": "nih_allofus", "concept_id": "1", "short_name": "Demographics and Baseline Survey"
    }
    assert "who_c" in model and "who_d" not in model
    assert not any(k.startswith("ukbb_") for k in model)  # skipped, not an error


def test_missing_registry_policies(spark):
    with pytest.raises(FileNotFoundError):
        harmonise(spark, {}, MODEL_SPECS, ["usaid"])
    with pytest.raises(ValueError):
        select_specs(MODEL_SPECS, ["nope"])
    with pytest.raises(ValueError):
        harmonise(spark, {}, MODEL_SPECS, ["uk_biobank"])


def test_nulls_are_filled_before_dedup(spark):
    long = "x" * 150
    table = raw(
        spark,
        [(None, "first", None), (None, "second", "c"), ("1", long, None), ("1", "later", "d"), ("é", None, "")],
        ["field_id", "title", "notes"],
    )
    got = store_rows(harmonise_registry(table, HASH_SPECS["uk_biobank"]))
    assert set(got) == {"UKB_FIELD_UNKNOWN", "UKB_FIELD_1", "UKB_FIELD_é"}
    assert got["UKB_FIELD_UNKNOWN"]["document"].endswith("Category: General Health | Description: first")
    assert got["UKB_FIELD_1"]["short_name"] == long[:100]
    assert long in got["UKB_FIELD_1"]["document"]
    assert got["UKB_FIELD_é"]["short_name"] == "Unknown Field Description"


def test_empty_definition_falls_back_to_label(spark):
    table = raw(spark, [("A", "lab", None, ""), ("B", "lab", None, None)],
                ["IndicatorId", "Label", "ShortName", "Definition"])
    got = store_rows(harmonise_registry(table, HASH_SPECS["usaid"]))
    assert got["DHS_A"]["document"].endswith("Definition: lab")
    assert got["DHS_B"]["document"].endswith("Definition: No Context Clarified")
    assert got["DHS_A"]["short_name"] == "Unknown Short Label"


def test_row_index_is_the_id_of_last_resort(spark):
    table = raw(spark, [("", "", "a"), ("5", "", "b"), ("", "q", "c"), ("", "", "d")],
                ["concept_id", "question_code", "question_text"])
    got = harmonise_registry(table, MODEL_SPECS["nih_allofus"])
    assert sorted(r["id"] for r in got.collect()) == ["allofus_0", "allofus_3", "allofus_5", "allofus_q"]
    only_text = table.select("question_text", ORD)
    assert sorted(r["id"] for r in harmonise_registry(only_text, MODEL_SPECS["nih_allofus"]).collect()) == [
        f"allofus_{i}" for i in range(4)
    ]


def test_unified_golden(spark):
    landed = {k: seed_rows(spark, v["seed"]) for k, v in fixed.UNIFIED_REGISTRIES.items()}
    got = {r["variable_id"]: r for r in harmonise_unified(landed).collect()}
    assert got["31"]["table_id"] == "Cat_1002"
    assert got["31"]["composite_text"] == "UK_Biobank | sex | genetic or phenotypic sex reported by participant"
    ids = [r["id"] for r in H.unified_store_rows(harmonise_unified(landed)).collect()]
    assert "NHANES_Examination_BMXBMI" in ids


def skewed(spark, n=3000, seed=3):
    """A third of all rows share one key."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}", i) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_keep_first_does_not_depend_on_partitions(spark, partitions):
    data = skewed(spark)
    expected = {}
    for key, i in data:
        expected.setdefault(key, i)
    df = spark.createDataFrame(data, f"k string, {ORD} long").repartition(partitions)
    assert {r["k"]: r[ORD] for r in O.dedup_keep_first(df, ["k"]).collect()} == expected
    last = {k: i for k, i in data}
    assert {r["k"]: r[ORD] for r in O.dedup_keep_last(df, ["k"]).collect()} == last


@pytest.mark.parametrize("lanes", [1, 3])
def test_cap_per_group_and_overall(spark, lanes):
    data = skewed(spark)
    df = spark.createDataFrame(data, f"k string, {ORD} long").repartition(7)
    hot = [i for k, i in data if k == "hot"][:25]
    got = O.cap_rows(df, 25, ["k"], lanes=lanes)
    assert sorted(r[ORD] for r in got.where("k = 'hot'").collect()) == hot
    assert sorted(r[ORD] for r in O.cap_rows(df, 40, lanes=lanes).collect()) == list(range(40))


def test_cap_of_ten_thousand_is_pruned_before_the_shuffle(spark):
    df = spark.range(30_000).select(F.col("id").alias(ORD), (F.col("id") % 2).alias("k"))
    plan = O.cap_rows(df, 10_000, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_row_index_has_no_single_partition_data_exchange(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias(ORD)).repartition(5)
    numbered = O.row_index(df, buckets=16)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    # The only single-partition step is the running total over the buckets.
    assert plan.count("Exchange SinglePartition") == 1
    got = sorted((r[ORD], r["row_index"]) for r in numbered.collect())
    assert [i for _, i in got] == list(range(1000))


def test_scan_row_index_over_many_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(1000).select(F.format_string("%05d", "id").alias("value")).repartitionByRange(
        6, "value").sortWithinPartitions("value").write.text(path)
    scan = O.with_scan_order(spark.read.text(path))
    got = O.scan_row_index(scan).select("value", "row_index").collect()
    assert all(int(r["value"]) == r["row_index"] for r in got) and len(got) == 1000


def test_spread_only_touches_narrow_scans(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(1000).repartition(8).write.parquet(path)
    assert "Exchange" not in O.spread(spark.read.parquet(path), "id")._jdf.queryExecution().toString()
    one = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(one)
    assert O.spread(spark.read.parquet(one), "id", min_bytes=1).rdd.getNumPartitions() == 4
