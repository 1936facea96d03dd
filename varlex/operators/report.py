"""Counts and run reports over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlex import fixed

REPORT_SCHEMA = (
    "run_id string, source_key string, status string, error string, n_rows long, elapsed_s double"
)


def count_records(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_records"))


def distinct_sources(store: DataFrame) -> DataFrame:
    """Sorted distinct sources; a missing source reads ``unknown``.

    Rows with no metadata at all are left out where the store carries it.
    """
    if "metadata" in store.columns:
        store = store.where(F.size("metadata") > 0)
    return (
        store.select(F.coalesce("source", F.lit(fixed.UNKNOWN_SOURCE)).alias("source"))
        .distinct()
        .orderBy("source")
    )


def count_sources(store: DataFrame) -> DataFrame:
    if "metadata" in store.columns:
        store = store.where(F.size("metadata") > 0)
    named = F.coalesce("source", F.lit(fixed.UNKNOWN_SOURCE))
    return store.agg(F.count_distinct(named).alias("n_sources"))


def ingest_counts(rows: DataFrame) -> DataFrame:
    """Rows, distinct ids and duplicates per source of one batch.

    Ids are first counted per (source, id), so a source that holds a third of
    the rows is already spread when its totals are added up.
    """
    per_id = rows.groupBy("source", "id").agg(F.count(F.lit(1)).alias("_rows"))
    return per_id.groupBy("source").agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_ids")
    )
