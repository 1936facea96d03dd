"""File stream over a landing folder with an idempotent keyed upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from varlex.operators.embed import EncoderFactory
from varlex.operators.ordering import ORD
from varlex.operators.row_ledger import RowLedger
from varlex.plans.ingest import embed_corpus, harmonise_registry
from varlex.specs import RegistrySpec


def landing_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """New files of a landing folder as a stream that knows each row's split."""
    scan = spark.readStream.schema(schema).format(fmt).options(**options).load(path)
    split = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    return scan.select("*", split.alias("_split"))


def batch_order(batch: DataFrame) -> DataFrame:
    """Input order of one micro-batch; row ids are only allowed outside a stream."""
    order = F.struct("_split.file", "_split.block", F.monotonically_increasing_id().alias("seq"))
    return batch.withColumn(ORD, order).drop("_split")


def upsert_stream(
    stream: DataFrame,
    spec: RegistrySpec,
    store: str,
    checkpoint: str,
    encoder: EncoderFactory | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    available_now: bool = True,
) -> StreamingQuery:
    """Upsert every micro-batch into the store.

    A whole-row replace by id is idempotent, so a batch that is retried after a
    lost executor leaves the same store.  Where ids may be row numbers, these go
    on from batch to batch by a ledger beside the checkpoint, and a retried
    batch gets the numbers it had.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, first = prepare(batch_order(batch)), 0
        if spec.needs_row_index:
            ledger = RowLedger(batch.sparkSession, f"{checkpoint}-rows")
            first = ledger.rows_before(batch_id)
            ledger.commit(batch_id, rows.count())
        harmonised = harmonise_registry(rows, spec, first)
        embed_corpus(batch.sparkSession, harmonised, store, encoder, sources=[spec.source])

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
