"""Observation rows of matched variables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlex import fixed
from varlex.functions import text as X
from varlex.operators.ordering import ORD, first_n, order_columns
from varlex.operators.skew import HEAVY_SHARE, heavy_buckets, maybe_wanted, with_all_salts, with_salt

TARGET_COLUMNS = ["target_ordinal", "variable_id", "source_dataset"]


def valid_targets(records: DataFrame) -> DataFrame:
    """Matches that name a variable."""
    return records.where(
        (F.col("variable_id") != "") & (F.col("variable_id") != fixed.NOT_AVAILABLE)
    )


def route_targets(records: DataFrame) -> DataFrame:
    """Add the observation family and the wide table of every target."""
    return records.withColumns(
        {
            "variable_id": X.strip_whitespace("variable_id"),
            "family": X.route_source("source_dataset"),
            "wide_table": X.route_table("table_id"),
        }
    )


def limit_per_target(
    observations: DataFrame, n: int, keys: list[str], order: Column | str = ORD
) -> DataFrame:
    """The first n observations per variable in input order, ranked.

    Equal targets read the same rows, so limiting per variable before the join
    equals limiting per target after it, and the join multiplies at most n rows
    whatever share of the observations one variable holds.
    """
    return first_n(observations, n, keys, order_columns(observations, order), "observation_rank")


def observations_of(
    targets: DataFrame,
    observations: DataFrame,
    columns: list[str],
    n: int,
    keys: list[str] | None = None,
    order: Column | str = ORD,
    heavy_share: int = HEAVY_SHARE,
) -> DataFrame:
    """First n observations of every target record.

    One plan for target lists of any length.  A bitmap of the targets' keys
    drops other variables in the scan stage, before anything is ranked.  A
    variable that many observations share sends n rows from each map
    partition; these are merged in lanes first, so no task reads them all.
    Both sides then meet on the key, those of a variable that many targets
    name on (key, salt): only its n observations are copied to all salts.
    """
    keys = keys or ["variable_id"]
    wanted = targets.select(*dict.fromkeys(TARGET_COLUMNS + keys))
    order_columns = [ORD] if ORD in observations.columns else []
    rows = observations.select(*dict.fromkeys(keys + columns + order_columns))
    limited = limit_per_target(maybe_wanted(rows, wanted, keys), n, keys, order).drop(ORD)
    heavy = heavy_buckets(wanted, keys, heavy_share)
    salted = with_salt(wanted, heavy, keys, F.col("target_ordinal"))
    return salted.join(with_all_salts(limited, heavy, keys), [*keys, "_salt"]).drop("_salt")


def who_observations(
    targets: DataFrame, observations: DataFrame, n: int = fixed.OBSERVATIONS_DEFAULT, **options
) -> DataFrame:
    """Indicator observations by place and time."""
    columns = [c for c in fixed.WHO_COLUMNS if c not in TARGET_COLUMNS and c in observations.columns]
    found = observations_of(targets, observations, columns, n, **options)
    return found.select("target_ordinal", "observation_rank", "variable_id", "source_dataset", *columns)


def dhs_observations(
    targets: DataFrame, observations: DataFrame, n: int = fixed.OBSERVATIONS_DEFAULT, **options
) -> DataFrame:
    """Survey observations by country, year and characteristic."""
    columns = [c for c in fixed.DHS_COLUMNS if c not in TARGET_COLUMNS and c in observations.columns]
    found = observations_of(targets, observations, columns, n, **options)
    return found.select("target_ordinal", "observation_rank", "variable_id", "source_dataset", *columns)


def wide_to_long(
    wide: DataFrame,
    variables: list[str] | None = None,
    key: str = fixed.WIDE_KEY,
    value_type: str = "double",
) -> DataFrame:
    """(table_id, variable_id, key, value) of a wide measurement table.

    Rows without key or value are dropped.  Only the listed variables are
    unpivoted, so only their columns are scanned.
    """
    carried = [c for c in ("table_id", key, ORD) if c in wide.columns]
    names = [c for c in (variables if variables is not None else wide.columns)
             if c in wide.columns and c not in carried]
    if not names:
        empty = T.StructType(
            [wide.schema[c] for c in carried]
            + [T.StructField("variable_id", T.StringType()), T.StructField("value", T._parse_datatype_string(value_type))]
        )
        return wide.sparkSession.createDataFrame([], empty)
    typed = wide.select(*carried, *[F.col(f"`{c}`").cast(value_type).alias(c) for c in names])
    return typed.unpivot(carried, names, "variable_id", "value").where(
        F.col(key).isNotNull() & F.col("value").isNotNull()
    )


def wide_observations(
    targets: DataFrame, wide: DataFrame, n: int = fixed.OBSERVATIONS_DEFAULT, **options
) -> DataFrame:
    """Participant measurements of wide-table targets.

    The distinct target variables that are columns of the table are looked up
    first; there are never more of them than the table has columns.
    """
    columns = [c for c in wide.columns if c not in ("table_id", fixed.WIDE_KEY, ORD)]
    asked = targets.where(F.col("variable_id").isin(columns)).select("variable_id").distinct()
    present = [row["variable_id"] for row in asked.limit(len(columns)).collect()]
    long = wide_to_long(wide, sorted(present))
    keys = ["variable_id"]
    if "table_id" in long.columns:
        long = long.withColumnRenamed("table_id", "wide_table")
        keys = ["wide_table", "variable_id"]
    found = observations_of(targets, long, [fixed.WIDE_KEY, "value"], n, keys, **options)
    return found.select(
        "target_ordinal",
        "observation_rank",
        "variable_id",
        F.lit(fixed.WIDE_SOURCE).alias("source_dataset"),
        fixed.WIDE_KEY,
        "value",
    )


def union_observations(frames: list[DataFrame]) -> DataFrame:
    """Stack observation families; columns a family lacks are null.

    Column names in Spark ignore case, so the wide table's ``value`` becomes
    ``measured_value`` next to the text column ``Value``.  Sort by
    ``target_ordinal, observation_rank`` to read rows in target order.
    """
    renamed = [
        f.withColumnRenamed("value", "measured_value") if "value" in f.columns else f for f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
