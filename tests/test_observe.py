"""Observations of matches: hot variables, repeated targets, routing, wide tables."""

import random

import pytest
from pyspark.sql import functions as F

from varlex.operators import observe as O
from varlex.operators.ordering import ORD
from varlex.operators.skew import HEAVY_SHARE, heavy_buckets, maybe_wanted, with_salt
from varlex.plans.observations import observations_for_matches

N = 7


@pytest.fixture(scope="module")
def observations(spark):
    rng = random.Random(1)
    data = [(("hot" if i % 3 == 0 else f"v{rng.randrange(50)}"), f"c{i}", 2000 + i % 9, float(i), str(i), i)
            for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(
        data, f"variable_id string, SpatialDim string, TimeDim long, NumericValue double, Value string, {ORD} long")
    return df.repartition(6), data


def targets(spark, names):
    return spark.createDataFrame(
        [(i, v, "who_gho") for i, v in enumerate(names)],
        "target_ordinal long, variable_id string, source_dataset string")


def brute(data, names, n=N):
    result = []
    for t, name in enumerate(names):
        own = sorted(r[5] for r in data if r[0] == name)[:n]
        result += [(t, rank, order) for rank, order in enumerate(own, 1)]
    return sorted(result)


@pytest.mark.parametrize("heavy_share", [1, HEAVY_SHARE, 1 << 40])
def test_first_n_of_every_target_record(spark, observations, heavy_share):
    df, data = observations
    # A third of the targets name the hot variable, some appear twice, one nowhere.
    names = ["hot" if i % 3 == 0 else f"v{i % 20}" for i in range(60)] + ["absent"]
    found = O.who_observations(targets(spark, names), df, N, heavy_share=heavy_share)
    got = sorted((r["target_ordinal"], r["observation_rank"], int(r["Value"])) for r in found.collect())
    assert got == brute(data, names)


def test_hot_variable_is_limited_before_the_shuffle(spark, observations):
    df, _ = observations
    plan = O.who_observations(targets(spark, ["hot"]), df, N)._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning(variable_id")
    assert "Partial" in plan[shuffle:] and "WindowGroupLimit" in plan[shuffle:]
    assert "BroadcastHashJoin" in plan[shuffle:]  # other variables are dropped in the scan stage
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_heavy_keys_are_spread(spark):
    names = ["hot" if i % 3 == 0 else f"v{i % 200}" for i in range(3000)]
    rows = targets(spark, names)
    salted = with_salt(rows, heavy_buckets(rows, ["variable_id"]), ["variable_id"], F.col("target_ordinal"))
    per_key = {r["variable_id"]: (r["salts"], r["n"]) for r in salted.groupBy("variable_id").agg(
        F.count_distinct("_salt").alias("salts"), F.count("*").alias("n")).collect()}
    assert per_key["hot"] == (32, 1000)
    assert all(salts == 1 for name, (salts, _) in per_key.items() if name != "hot")
    largest = salted.groupBy("variable_id", "_salt").count().agg(F.max("count")).first()[0]
    assert largest < 100


def test_the_bitmap_loses_no_wanted_key(spark):
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("k"))
    wanted = rows.where("cast(k as int) % 10 = 3")
    left = maybe_wanted(rows, wanted, ["k"])
    assert left.join(wanted, "k").count() == 5_000
    assert left.count() < 5_100
    assert maybe_wanted(rows, wanted.where("false"), ["k"]).count() == 0


def wide(spark):
    return spark.createDataFrame(
        [("DEMO_J", 3, 1.0, None), ("DEMO_J", 1, 2.0, 5.0), ("DEMO_J", 2, None, 6.0), ("BMX_J", 9, 4.0, 7.0),
         ("BMX_J", None, 4.0, 7.0)],
        "table_id string, SEQN long, AGE double, BMI double").withColumn(ORD, F.col("SEQN"))


def test_wide_to_long_scans_only_wanted_columns(spark, tmp_path):
    path = str(tmp_path / "wide")
    wide(spark).write.parquet(path)
    long = O.wide_to_long(spark.read.parquet(path), ["BMI", "NOPE"])
    assert sorted((r["table_id"], r["variable_id"], r["SEQN"], r["value"]) for r in long.collect()) == [
        ("BMX_J", "BMI", 9, 7.0), ("DEMO_J", "BMI", 1, 5.0), ("DEMO_J", "BMI", 2, 6.0)]
    schema = long._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "BMI" in schema and "AGE" not in schema
    assert O.wide_to_long(wide(spark), []).count() == 0


def test_all_families_in_one_table(spark, observations):
    df, data = observations
    dhs = spark.createDataFrame([("d1", "Kenya", 2014, "5", "Total", 0)],
                                f"variable_id string, CountryName string, SurveyYear long, Value string, CharacteristicLabel string, {ORD} long")
    records = spark.createDataFrame(
        [(0, " AGE ", "", "cdc_nhanes"), (1, "hot", "x", " WHO_gho"), (2, "d1", None, "USAID_DHS"), (3, "hot", "x", "mimic_iv"),
         (4, "N/A", "", "who"), (5, "", "", "who"), (6, "BMI", "bmx_j", "NHANES"), (7, "nothing", "", "nhanes"),
         (8, None, "", "who")],
        "target_ordinal long, variable_id string, table_id string, source_dataset string")
    rows = observations_for_matches(records, df, dhs, wide(spark), n=2).orderBy("target_ordinal", "observation_rank").collect()
    got = [(r["target_ordinal"], r["variable_id"], r["source_dataset"], r["SEQN"], r["measured_value"], r["CountryName"]) for r in rows]
    assert got == [
        (0, "AGE", "NHANES", 1, 2.0, None), (0, "AGE", "NHANES", 3, 1.0, None),
        (1, "hot", " WHO_gho", None, None, None), (1, "hot", " WHO_gho", None, None, None),
        (2, "d1", "USAID_DHS", None, None, "Kenya"),
        (6, "BMI", "NHANES", 9, 7.0, None),
    ]
    assert [int(r["Value"]) for r in rows if r["target_ordinal"] == 1] == [r[2] for r in brute(data, ["hot"], 2)]
