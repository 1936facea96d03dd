"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import documents, inputs

SHARDS = 24
ROW_OVERHEAD = 8
# Rows of one shard that are numbered together, about.
BLOCK_ROWS = 1 << 17
# Copies of one row that are written out again at a time.
REPEAT = 1 << 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score for the key is highest; ties go to the smaller shard.

    Each shard's score is -weight / ln(u), u a uniform hash of key and shard
    in (0, 1).  A shard's score for a key never depends on the others, so a
    new shard only takes the records it wins, and a changed weight only moves
    records from or to that shard.  A null key hashes like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    scores = []
    for shard, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        score = F.lit(float(weight)) / -F.ln(unit)
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("negative")))
    return -F.greatest(scores[0], *scores)["negative"]


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_by: float = 1.0,
    doc_id: str = "doc_id",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``size`` is the number of UTF-8 bytes of the text plus 8; a null text has
    none, as has an empty one, and checksum 0.  ``shard`` depends on doc_id
    and the weights alone; ``grown_shard`` is the shard with one more of
    weight ``grown_by``.  ``slot`` numbers the rows of a shard from 0 without
    gaps.  Rows are numbered in hash blocks of about ``block_rows`` rows and
    shard, whose offsets come from the blocks' counts, so no task sees a whole
    shard.  Equal rows (repeats, null ids) are one row with a count until they
    have their slots.  Other columns are not read; an empty table gives no rows.
    """
    whole = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = inputs(docs, doc_id=doc_id, text=text).select(
        "doc_id", (F.octet_length(whole) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(whole).alias("text_crc32")
    )
    total = docs.count()
    blocks = max(1, -(-total // (block_rows * len(weights))))
    block = F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(blocks)).alias("block")
    groups = (
        rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("rows"))
        .select("*", rendezvous(F.col("doc_id"), weights).alias("shard"), block)
    )
    counts = groups.groupBy("shard", "block").agg(F.sum("rows").alias("in_block"))
    # One row per block and shard: a thousandth of a per cent of the table.
    before = F.expr("sum(in_block) over (partition by shard order by block rows between unbounded preceding and current row)")
    offsets = counts.select("shard", "block", (before - F.col("in_block")).alias("offset"))
    inside = F.expr(
        "sum(rows) over (partition by shard, block order by doc_id, text_crc32, size "
        "rows between unbounded preceding and current row)"
    )
    placed = (
        groups.withColumn("upto", inside).join(offsets, ["shard", "block"])
        .withColumn("first", F.col("offset") + F.col("upto") - F.col("rows"))
    )
    # Repeats come apart in two steps, so that no array is longer than REPEAT.
    last = F.col("rows") - 1
    apart = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(REPEAT).cast("long")))).withColumn(
        "repeat", F.explode(F.sequence(F.col("at"), F.least(last, F.col("at") + REPEAT - 1)))
    )
    return apart.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("repeat")).alias("slot"),
        rendezvous(F.col("doc_id"), [*weights, grown_by]).cast("int").alias("grown_shard"),
    )


def op2_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))
