"""Row numbers that go on over batches: a ledger of how many rows each batch had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.operators.ordering import number_rows
from varlex.session import path_exists


class RowLedger:
    """One folder per batch below ``path``; a batch that is repeated gets the numbers it had.

    Batches are numbered in the order in which their rows go on.  One writer
    at a time, as with the store that the rows are for.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _lines(self) -> DataFrame:
        schema = "rows long, batch long"
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def rows_before(self, batch: int) -> int:
        """Rows of all batches with smaller numbers: one number reaches the driver."""
        return self._lines().where(F.col("batch") < batch).agg(F.sum("rows")).first()[0] or 0

    def next_batch(self) -> int:
        last = self._lines().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def commit(self, batch: int, rows: int) -> None:
        line = self.spark.createDataFrame([(rows,)], "rows long").coalesce(1)
        line.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def numbered(self, rows: DataFrame, batch: int, name: str = "row_index") -> DataFrame:
        """``rows`` of a batch, by their ``_ord``, behind those of all batches before."""
        return number_rows(rows, name).withColumn(name, F.col(name) + F.lit(self.rows_before(batch)))
