"""Observation operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions import text as X
from varlex.operators import observe as O
from varlex.operators.ordering import ORD
from varlex.plans.observations import observations_for_matches as for_matches
from varlex.plans.registered import roles as R
from varlex.session import fresh_path
from varlex.sources import wide_tables

N = fixed.OBSERVATIONS_PER_MATCH
FEW = 5


def _targets(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    routed = O.route_targets(O.valid_targets(R.records(spark, sf_dir)))
    return routed.where(F.col("family") == family)


def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.valid_targets(R.records(spark, sf_dir))


def route_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records(spark, sf_dir).select(
        "target_ordinal", X.route_source("source_dataset").alias("family")
    )


def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records(spark, sf_dir).select(
        "target_ordinal", X.route_table("table_id").alias("wide_table")
    )


def who_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.who_observations(_targets(spark, sf_dir, "WHO"), R.who_rows(spark, sf_dir), N)
    return R.longs(found, "observation_rank")


def dhs_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.dhs_observations(_targets(spark, sf_dir, "DHS"), R.dhs_rows(spark, sf_dir), N)
    return R.longs(found, "observation_rank")


def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.wide_to_long(R.wide_rows(spark, sf_dir)).drop(ORD)


def wide_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.wide_observations(_targets(spark, sf_dir, "NHANES"), R.wide_rows(spark, sf_dir), N)
    return R.longs(found, "observation_rank")


def limit_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = O.limit_per_target(R.who_rows(spark, sf_dir), FEW, ["variable_id"])
    return R.longs(limited.drop(ORD), "observation_rank")


def salted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target's variable counts as one that many targets name."""
    found = O.who_observations(
        _targets(spark, sf_dir, "WHO"), R.who_rows(spark, sf_dir), FEW, heavy_share=1 << 40
    )
    return R.longs(found, "observation_rank")


def scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide tables in one folder each, some without a variable; the catalogue says which files a target needs."""
    path, listed = fresh_path(spark, "wide"), fresh_path(spark, "catalogue")
    rows = R.wide_rows(spark, sf_dir).drop(ORD)
    demo = F.col("table_id") == "DEMO_J"
    rows.where(demo).drop("c_acctbal").write.partitionBy("table_id").parquet(path)
    rows.where(demo).drop("c_nationkey").write.mode("append").partitionBy("table_id").parquet(path)
    rows.where(~demo).withColumn("other", F.lit("x")).write.mode("append").partitionBy("table_id").parquet(path)
    wide_tables.write_catalogue(spark, path, listed)
    targets = O.route_targets(O.valid_targets(R.records(spark, sf_dir))).where(F.col("family") == "NHANES")
    return wide_tables.scan_targets(spark, wide_tables.read_catalogue(spark, listed), targets)


def union_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw observation tables of two families stacked."""
    return O.union_observations([R.who_rows(spark, sf_dir).drop(ORD), R.dhs_rows(spark, sf_dir).drop(ORD)])


def observations_for_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = for_matches(
        R.records(spark, sf_dir), R.who_rows(spark, sf_dir), R.dhs_rows(spark, sf_dir),
        R.wide_rows(spark, sf_dir), N,
    )
    return R.longs(found, "observation_rank")


QUERIES = {
    fn.__name__: fn
    for fn in (
        valid_targets, route_source, route_table, who_observations, dhs_observations, wide_to_long,
        wide_observations, limit_per_target, salted_observations, scan_targets, union_observations,
        observations_for_matches,
    )
}

_ROUTED = R.ctes("records", "who_rows", "dhs_rows", "wide_long") + f""",
    targets AS (
        SELECT target_ordinal, trim(variable_id) AS variable_id, source_dataset,
               CASE WHEN table_id = '' OR table_id = 'N/A' THEN 'DEMO_J' ELSE upper(table_id) END AS wide_table,
               CASE WHEN contains(lower(source_dataset), 'who') OR contains(lower(source_dataset), 'gho') THEN 'WHO'
                    WHEN contains(lower(source_dataset), 'dhs') OR contains(lower(source_dataset), 'usaid') THEN 'DHS'
                    WHEN contains(lower(source_dataset), 'nhanes') THEN 'NHANES' END AS family
        FROM records WHERE variable_id <> '' AND variable_id <> 'N/A'),
    who AS (
        SELECT t.target_ordinal, o.observation_rank, t.variable_id, t.source_dataset,
               o.SpatialDim, o.TimeDim, o.NumericValue, o.Value
        FROM targets t JOIN who_rows o ON o.variable_id = t.variable_id WHERE t.family = 'WHO'),
    dhs AS (
        SELECT t.target_ordinal, o.observation_rank, t.variable_id, t.source_dataset,
               o.CountryName, o.SurveyYear, o.Value, o.CharacteristicLabel
        FROM targets t JOIN dhs_rows o ON o.variable_id = t.variable_id
        WHERE t.family = 'DHS' AND o.observation_rank <= {N}),
    wide AS (
        SELECT t.target_ordinal, o.observation_rank, t.variable_id, 'NHANES' AS source_dataset, o.SEQN, o.value
        FROM targets t JOIN wide_long o ON o.variable_id = t.variable_id AND o.table_id = t.wide_table
        WHERE t.family = 'NHANES' AND o.observation_rank <= {N})"""

SQL = {
    "valid_targets": R.ctes("records") + """
        SELECT * FROM records WHERE variable_id <> '' AND variable_id <> 'N/A'""",
    "route_source": R.ctes("records") + """
        SELECT target_ordinal,
               CASE trim(source_dataset) WHEN 'Who_GHO' THEN 'WHO' WHEN 'USAID_DHS' THEN 'DHS'
                                         WHEN 'cdc_nhanes' THEN 'NHANES' END AS family
        FROM records""",
    "route_table": R.ctes("records") + """
        SELECT target_ordinal, CASE table_id WHEN 'N/A' THEN 'DEMO_J' ELSE upper(table_id) END AS wide_table
        FROM records""",
    "who_observations": _ROUTED + f" SELECT * FROM who WHERE observation_rank <= {N}",
    "salted_observations": _ROUTED + f" SELECT * FROM who WHERE observation_rank <= {FEW}",
    "dhs_observations": _ROUTED + " SELECT * FROM dhs",
    "wide_observations": _ROUTED + " SELECT * FROM wide",
    "wide_to_long": R.ctes("wide_long") + " SELECT table_id, variable_id, SEQN, value FROM wide_long",
    "scan_targets": _ROUTED + """
        SELECT o.table_id, o.variable_id, o.SEQN, o.value FROM wide_long o
        WHERE EXISTS (SELECT 1 FROM targets t WHERE t.family = 'NHANES' AND t.variable_id = o.variable_id AND t.wide_table = o.table_id)""",
    "limit_per_target": R.ctes("who_rows") + f" SELECT * FROM who_rows WHERE observation_rank <= {FEW}",
    "union_observations": R.ctes("who_rows", "dhs_rows") + """
        SELECT variable_id, SpatialDim, TimeDim, NumericValue, Value,
               NULL::VARCHAR AS CountryName, NULL::BIGINT AS SurveyYear, NULL::VARCHAR AS CharacteristicLabel
        FROM who_rows
        UNION ALL
        SELECT variable_id, NULL, NULL, NULL, Value, CountryName, SurveyYear, CharacteristicLabel FROM dhs_rows""",
    "observations_for_matches": _ROUTED + f"""
        SELECT target_ordinal, observation_rank, variable_id, source_dataset, SpatialDim, TimeDim, NumericValue,
               Value, NULL::VARCHAR AS CountryName, NULL::BIGINT AS SurveyYear,
               NULL::VARCHAR AS CharacteristicLabel, NULL::BIGINT AS SEQN, NULL::DOUBLE AS measured_value
        FROM who WHERE observation_rank <= {N}
        UNION ALL
        SELECT target_ordinal, observation_rank, variable_id, source_dataset, NULL, NULL, NULL, Value,
               CountryName, SurveyYear, CharacteristicLabel, NULL, NULL FROM dhs
        UNION ALL
        SELECT target_ordinal, observation_rank, variable_id, source_dataset, NULL, NULL, NULL, NULL, NULL, NULL,
               NULL, SEQN, value FROM wide""",
}
