"""Ingest of landed files: where a registry's files may lie, the first usable place, a store and a report."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from varlex.operators.embed import EncoderFactory
from varlex.plans.ingest import harmonise_registry, landed_or_fallback
from varlex.session import path_exists
from varlex.sources import bucket_store
from varlex.sources.dictionaries import PROBLEM, read_dictionary
from varlex.specs import RegistrySpec, select_specs

REPORT_SCHEMA = (
    "batch string, source_key string, status string, error string, n_rows long, n_landed long, n_bad long, elapsed_s double"
)


@dataclass(frozen=True)
class Landing:
    """The places of a registry's files in order of preference, and how to read them.

    ``columns`` are the raw columns; without them those that the spec renames,
    and its others as they are.  A place is usable if its rows hold more than ``min_chars``
    characters.
    """

    locations: tuple[str, ...]
    fmt: str = "auto"
    key: str | None = None
    columns: tuple[str, ...] = ()
    min_chars: int = 0
    one_line_records: bool = False


def raw_columns(spec: RegistrySpec) -> list[str]:
    """What a registry's files call its columns: the names before renaming."""
    return [*spec.rename, *(c for c in spec.columns if c not in spec.rename.values())]


def first_usable(spark: SparkSession, landing: Landing, columns: Iterable[str]) -> DataFrame | None:
    """All rows and problems of the first place that holds enough; null-safe and lazy.

    None if no place exists.  Places that do are read twice, once for one
    number each; the choice is a join with one row, so nothing runs before the
    rows are asked for.
    """
    columns = list(landing.columns or columns)
    there = [(k, p) for k, p in enumerate(landing.locations) if path_exists(spark, p)]
    if not there:
        return None
    tagged = reduce(lambda a, b: a.unionByName(b), [
        read_dictionary(spark, p, columns, landing.fmt, landing.key, one_line_records=landing.one_line_records).withColumn("_priority", F.lit(k))
        for k, p in there
    ])
    chars = sum((F.coalesce(F.length(f"`{c}`"), F.lit(0)) for c in columns), F.lit(0))
    chosen = (
        tagged.where(F.col(PROBLEM).isNull()).groupBy("_priority").agg(F.sum(chars).alias("_chars"))
        .where(F.col("_chars") > landing.min_chars).agg(F.min("_priority").alias("_priority"))
    )
    return tagged.join(F.broadcast(chosen), "_priority", "left_semi").drop("_priority")


def ingest_landed(
    spark: SparkSession, landings: Mapping[str, Landing], specs: Mapping[str, RegistrySpec], store: str, report: str, batch: str,
    keys: Iterable[str] = ("all",), encoder: EncoderFactory | None = None, buckets: int = bucket_store.BUCKETS,
) -> DataFrame:
    """Landed files of the chosen registries into a bucket store, one commit for each; returns the report's rows of this batch.

    A registry without a usable place follows its policy: ``seed`` takes the
    spec's rows, ``skip`` nothing, ``raise`` fails.  A failing registry is
    reported and doesn't stop the others.  A batch that is repeated changes
    nothing in the store.  Status is ok, seeded, skipped or failed; ``n_bad``
    counts what the files held besides rows.  The report is appended to the
    parquet table ``report``, one row for each registry.
    """
    lines = []
    for key, spec in select_specs(specs, keys).items():
        started = time.monotonic()
        status, error, sizes = "ok", None, {"n_landed": 0, "n_bad": 0, "n_rows": 0}
        try:
            read = first_usable(spark, landings[key], raw_columns(spec)) if key in landings else None
            if read is not None:
                sizes |= read.agg(
                    F.count_if(F.col(PROBLEM).isNull()).alias("n_landed"), F.count_if(F.col(PROBLEM).isNotNull()).alias("n_bad")
                ).first().asDict()
            raw = read.where(F.col(PROBLEM).isNull()).drop(PROBLEM) if sizes["n_landed"] else None
            if raw is None:
                status = "seeded" if spec.on_missing == "seed" else "skipped"
                raw = landed_or_fallback(spark, spec, None)
            if raw is not None:
                rows = harmonise_registry(raw, spec)
                bucket_store.embed_batch(spark, rows, store, f"{batch}/{key}", encoder, buckets, spec.unique_ids)
                sizes["n_rows"] = rows.count()
        except Exception as failure:  # noqa: BLE001 - reported, not swallowed
            status, error = "failed", str(failure)
        lines.append((batch, key, status, error, sizes["n_rows"], sizes["n_landed"], sizes["n_bad"], time.monotonic() - started))
    spark.createDataFrame(lines, REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(report)
    return spark.read.schema(REPORT_SCHEMA).parquet(report).where(F.col("batch") == batch)


class StreamReport(StreamingQueryListener):
    """Appends one report row for each micro-batch of a stream that had rows."""

    def __init__(self, spark: SparkSession, report: str, source_key: str):
        self.spark, self.report, self.source_key = spark, report, source_key

    def _append(self, batch: str, status: str, error: str | None, rows: int, seconds: float) -> None:
        line = [(batch, self.source_key, status, error, rows, rows, 0, seconds)]
        self.spark.createDataFrame(line, REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(self.report)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.numInputRows:
            self._append(f"{progress.runId}/{progress.batchId}", "ok", None, progress.numInputRows, progress.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._append(str(event.runId), "failed", str(event.exception), 0, 0.0)
