"""What the operators of this subpackage share: input columns, batches, durable cuts."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.session import shared_dir

# Words of a text: maximal runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Long texts come in small batches, so that a Python worker holds a few MB at a time.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and make sure that a shared checkpoint folder is set."""
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def inputs(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Whatever else a table carries, names that clash included, never meets the
    columns an operator adds.
    """
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def durable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, lineage cut.

    Readers survive the loss of executors, and Spark's cleaner removes the
    files when the frame is no longer referenced.
    """
    prepared(df.sparkSession)
    return df.checkpoint(eager=True)


def split_groups(rows: DataFrame, key: str, by: str, group_rows: int) -> DataFrame:
    """``rows`` with a column ``bucket``: groups in which every two rows of a key still meet.

    A key with up to ``group_rows`` rows is one bucket.  The rows of a larger
    one are hashed by ``by`` into parts, and every two parts meet in a bucket
    of their own, so that no bucket grows with the data.
    """
    large = durable(
        rows.groupBy(key).count().where(F.col("count") > group_rows)
        .select(key, F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    )
    if large.isEmpty():
        return rows.withColumn("bucket", F.xxhash64(key, F.lit(0), F.lit(0)))
    return (
        rows.join(large, key, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64(by, F.lit(1)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where((F.col("parts") == 1) | (F.col("other") != F.col("part")))
        .withColumn("bucket", F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other")))
        .drop("parts", "part", "other")
    )


def maybe_among(rows: DataFrame, ids: DataFrame, column: str, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """``rows`` split into those whose ``column`` may be among ``ids`` and those where it isn't.

    A bitmap with one hash and 2 ** ``bits`` places, at most 2 ** (bits - 6)
    rows of two longs (4 MB), is broadcast; with very many ids it lets all
    rows through, which costs a larger join, not results.  Rows with a null
    count as possible.
    """
    place = F.xxhash64(column).bitwiseAND((1 << bits) - 1)
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(_place & 63 as int))")
    bitmap = F.broadcast(durable(
        ids.select(place.alias("_place")).select(F.shiftright("_place", 6).alias("_word"), bit.alias("_bit"))
        .groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    ))
    marked = (
        rows.withColumn("_place", place).withColumn("_word", word).join(bitmap, "_word", "left")
        .withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
        .drop("_word", "_place", "_bits")
    )
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo: the folds of the evaluation; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def per_worker(key, make):
    """What ``make`` returns, made once in each Python process and kept there between tasks.

    Functions travel to the workers by value, so a module's own globals
    wouldn't last; ``sys`` does.
    """
    kept = sys.__dict__.setdefault("_varlex_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget_others(*keys) -> None:
    """Drop what ``per_worker`` keeps in this Python process under other keys.

    Workers outlive the stages of a pipeline; without this the caches of all
    its operators would add up in each of them.  What is free by then goes back
    to the system, where the C library can do that.
    """
    kept = sys.__dict__.get("_varlex_kept", {})
    for key in [k for k in kept if k not in keys]:
        del kept[key]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


class BoundedCache(dict):
    """Results by word, kept between batches and tasks of one Python worker.

    It is emptied when its entries weigh more than ``limit`` bytes, about,
    which costs time, never results.
    """

    entry = 240

    def __init__(self, limit: int = 240_000_000):
        super().__init__()
        self.limit, self.held = limit, 0

    def missing(self, words: Iterable[str]) -> set[str]:
        """The words that the caller has to put in now; afterwards all of ``words`` are there."""
        wanted = set(words)
        new = {w for w in wanted if w not in self}  # difference() would walk through the whole cache
        if new and self.held + self.weight(new) > self.limit:
            self.clear()
            self.held, new = 0, wanted
        self.held += self.weight(new)
        return new

    def weight(self, words: set[str]) -> int:
        return sum(map(len, words)) * 4 + self.entry * len(words)


def chunked_matches(pattern, text: str, long: int = 1 << 20, step: int = 100_000) -> Iterator[list[str]]:
    """All matches of a pattern without groups, in lists of bounded length where the text is long."""
    if len(text) <= long:
        yield pattern.findall(text)
        return
    found: list[str] = []
    for match in pattern.finditer(text):
        found.append(match.group())
        if len(found) == step:
            yield found
            found = []
    yield found
