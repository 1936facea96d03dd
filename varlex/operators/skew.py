"""Sketches that keep joins even: a mergeable bitmap of wanted keys and the keys that many rows share.

Both are aggregates: they are combined inside every map partition, have a size
that doesn't depend on the data, and stay in the plan, so nothing is collected
before the job runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bitmap has 2 ** BITS places: at most 2 ** (BITS - 6) rows of two longs, 4 MB.
BITS = 24
# Rows are counted by hash in so many buckets; a bucket is heavy if it has more than one row in HEAVY_SHARE.
SKETCH_BUCKETS = 4_096
HEAVY_SHARE = 64
SALTS = 32


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def _place(keys: Sequence[str]) -> Column:
    return _hash(keys, 1).bitwiseAND((1 << BITS) - 1)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def key_bitmap(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(_word, _bits): a bitmap of the keys' hashes; those of two tables merge by ``bit_or``."""
    return rows.select(_place(keys).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(
        F.bit_or(_bit(F.col("_place"))).alias("_bits")
    )


def maybe_wanted(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` without most of those whose key isn't in ``wanted``; none that is there is lost.

    The broadcast bitmap never exceeds its 4 MB; with very many keys it lets
    more rows through, and a join behind it settles the rest.
    """
    bitmap = F.broadcast(key_bitmap(wanted, keys))
    place = _place(keys)
    marked = rows.join(bitmap, F.shiftright(place, 6) == F.col("_word"))
    return marked.where(F.col("_bits").bitwiseAND(_bit(place)) != 0).select(*rows.columns)


def heavy_buckets(rows: DataFrame, keys: Sequence[str], share: int = HEAVY_SHARE) -> DataFrame:
    """(_heavy): hash buckets that hold more than one row in ``share``; fewer than ``share`` of them."""
    counts = rows.groupBy(F.pmod(_hash(keys, 2), F.lit(SKETCH_BUCKETS)).alias("_heavy")).count()
    # One row with at most SKETCH_BUCKETS counts.
    listed = counts.agg(F.collect_list(F.struct("_heavy", "count")).alias("all"), F.sum("count").alias("rows"))
    return listed.select(F.inline("all"), "rows").where(F.col("count") > F.col("rows") / share).select("_heavy")


def with_salt(rows: DataFrame, heavy: DataFrame, keys: Sequence[str], by: Column, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``_salt``: 0, but for rows of heavy keys one of ``salts`` by the hash of ``by``."""
    marks = F.broadcast(heavy.withColumn("_is_heavy", F.lit(True)))
    marked = rows.join(marks, F.pmod(_hash(keys, 2), F.lit(SKETCH_BUCKETS)) == F.col("_heavy"), "left")
    salt = F.when(F.col("_is_heavy"), F.pmod(F.xxhash64(by, F.lit(4)), F.lit(salts))).otherwise(F.lit(0))
    return marked.select(*rows.columns, salt.cast("int").alias("_salt"))


def with_all_salts(rows: DataFrame, heavy: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """``rows`` with every ``_salt`` a partner can have: rows of heavy keys are copied, the others are not."""
    marks = F.broadcast(heavy.withColumn("_is_heavy", F.lit(True)))
    marked = rows.join(marks, F.pmod(_hash(keys, 2), F.lit(SKETCH_BUCKETS)) == F.col("_heavy"), "left")
    every = F.when(F.col("_is_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.select(*rows.columns, F.explode(every).alias("_salt"))
