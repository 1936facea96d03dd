"""Input order on a cluster: ordinals, keep-first, first-n and row numbers.

Nothing here sorts a whole table in one task.  ``row_number() <= n`` filters
become Spark's WindowGroupLimit, which drops losing rows inside every map
partition before the shuffle, so a key that holds a third of all rows sends at
most ``n`` rows per map partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "_ord"
ROW_GROUP_BYTES = 128 << 20
SPLITS_BROADCAST = 100_000


def with_scan_order(scan: DataFrame) -> DataFrame:
    """Attach the input order of a file scan as ``_ord``.

    The id rises within a split; path and block start order the splits, because
    Spark packs splits into partitions by size.  Call it directly on the scan.
    """
    return scan.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias(ORD),
    )


def spread(scan: DataFrame, *keys: str, min_bytes: int = 4 << 20) -> DataFrame:
    """Hash a scan over all cores if it has far fewer splits than there are cores.

    A single row group, a compressed text file or a multi-line JSON file is one
    split; work after it would run on one core.  A table with enough splits, or
    a small one, is returned as it is and nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < min_bytes or size * 4 > cores * ROW_GROUP_BYTES:
        return scan
    # Byte ranges of one row group are separate splits, but only one has rows.
    if max(len(scan.inputFiles()), size // ROW_GROUP_BYTES) * 4 > cores:
        return scan
    return scan.repartition(cores, *keys)


def merge_lanes(spark: SparkSession) -> int:
    """How many lanes a two-step merge uses; one on a small cluster."""
    return max(1, spark.sparkContext.defaultParallelism // 64)


def first_n(
    df: DataFrame,
    n: int,
    by: Sequence[str],
    order: Sequence[Column],
    rank: str | None = None,
    lanes: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every group, optionally with their rank.

    With ``lanes > 1`` survivors are first merged per (group, lane) and then per
    group, so the last task of a hot group reads ``lanes * n`` rows whatever the
    number of input partitions.
    """
    lanes = merge_lanes(df.sparkSession) if lanes is None else lanes
    position = rank or "_position"
    if lanes > 1:
        laned = df.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
        local = Window.partitionBy(*by, "_lane").orderBy(*order)
        df = (
            laned.withColumn(position, F.row_number().over(local))
            .where(F.col(position) <= n)
            .drop(position, "_lane")
        )
    ranked = df.withColumn(
        position, F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).where(F.col(position) <= n)
    return ranked if rank else ranked.drop(position)


def order_columns(df: DataFrame, order: Column | str, latest: bool = False) -> list[Column]:
    """Sort columns of an order; a struct is taken apart, which sorts faster."""

    def leaves(path: str, kind: T.DataType) -> list[str]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind.fields for leaf in leaves(f"{path}.`{f.name}`", f.dataType)]
        return [path]

    if isinstance(order, str):
        columns = [F.col(leaf) for leaf in leaves(order, df.schema[order].dataType)]
    else:
        columns = [order]
    return [c.desc() if latest else c.asc() for c in columns]


def dedup_keep_first(
    df: DataFrame, keys: Sequence[str], order: Column | str = ORD
) -> DataFrame:
    """Keep the earliest row of every key; a map partition sends one row per key."""
    return first_n(df, 1, keys, order_columns(df, order), lanes=1)


def dedup_keep_last(
    df: DataFrame, keys: Sequence[str], order: Column | str = ORD
) -> DataFrame:
    """Keep the latest row of every key; a map partition sends one row per key."""
    return first_n(df, 1, keys, order_columns(df, order, latest=True), lanes=1)


def cap_rows(
    df: DataFrame,
    n: int,
    by: Sequence[str] = (),
    order: Column | str = ORD,
    lanes: int | None = None,
) -> DataFrame:
    """The first ``n`` rows per group (or overall) in input order."""
    columns = order_columns(df, order)
    if by:
        return first_n(df, n, by, columns, lanes=lanes)
    whole = first_n(df.withColumn("_all", F.lit(0)), n, ["_all"], columns, lanes=lanes)
    return whole.drop("_all")


def row_index(
    df: DataFrame, order: str = ORD, name: str = "row_index", buckets: int | None = None
) -> DataFrame:
    """0-based position of every row in the order of a unique numeric column; null orders come last.

    Quantiles of the order column give range buckets.  A bucket's offset is the
    number of rows in the buckets before it (one row per bucket), and rows are
    numbered inside their bucket, so no task sees the whole table.
    """
    spark = df.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(
        F.percentile_approx(F.col(order).cast("double"), quantiles, 10_000).alias("cuts")
    ).first()["cuts"]
    splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    keyed = df.withColumn("_position", F.col(order).cast("double"))
    ranges = Bucketizer(splits=splits, inputCol="_position", outputCol="_bucket", handleInvalid="keep").transform(keyed)
    bucketed = ranges.withColumn("_bucket", F.when(F.col("_position").isNull(), float(len(splits))).otherwise(F.col("_bucket")))
    return _number_within(bucketed, ["_bucket"], [F.col(order).asc_nulls_last()], name, bounded=True).drop(
        "_position", "_bucket"
    )


def scan_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based row number over a file scan that carries ``with_scan_order``; call it before rows are dropped.

    The rows of a split follow one another, so a row's number is its split's
    offset and its distance from the split's first row.  Rows aren't moved:
    one row for each split comes back to them, broadcast for up to
    ``SPLITS_BROADCAST`` files (some 20 MB) and joined as Spark chooses beyond.
    """
    split = df.groupBy(F.col(f"{ORD}.file").alias("_file"), F.col(f"{ORD}.block").alias("_block"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = split.agg(F.count("*").alias("_rows"), F.min(f"{ORD}.seq").alias("_first")).select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    if len(df.inputFiles()) <= SPLITS_BROADCAST:
        splits = F.broadcast(splits)
    here = (F.col(f"{ORD}.file") == F.col("_file")) & (F.col(f"{ORD}.block") == F.col("_block"))
    return df.join(splits, here).withColumn(name, F.col("_offset") + F.col(f"{ORD}.seq") - F.col("_first")).drop(
        "_file", "_block", "_first", "_offset"
    )


def _number_within(
    df: DataFrame, keys: list[str], order: list[Column], name: str, bounded: bool
) -> DataFrame:
    """Number rows by (keys, order): offsets per key plus a rank inside it.

    The running total runs over one row per key: the bucket count, or the
    number of file splits.
    """
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = df.withColumn("_inside", inside)
    # Bucket offsets are at most `buckets` rows; split offsets are left to AQE.
    side = F.broadcast(offsets) if bounded else offsets
    return (
        numbered.join(side, keys)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )


def number_rows(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Row numbers from whatever ``_ord`` holds: a scan order or a number."""
    if isinstance(df.schema[ORD].dataType, T.StructType):
        return scan_row_index(df, name)
    return row_index(df, ORD, name)
