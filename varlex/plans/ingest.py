"""Harmonise registries, embed documents and keep the store up to date."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlex import fixed
from varlex.functions import text as X
from varlex.operators import harmonise as H
from varlex.operators.embed import VECTOR_ROWS, EncoderFactory, add_hash_vector, changed_documents, model_embed
from varlex.operators.ordering import ORD, cap_rows, dedup_keep_first, dedup_keep_last, number_rows
from varlex.operators.report import REPORT_SCHEMA
from varlex.operators.row_ledger import RowLedger
from varlex.session import discard, fresh_path, path_exists
from varlex.sources.landing import seed_rows
from varlex.sources.sinks import touched_sources, upsert_encoded
from varlex.sources.stores import scan_vector_store
from varlex.specs import ROW_INDEX, RegistrySpec, select_specs

# With so many sources at most, staged rows lie in files by source; each writing task may make one for each.
FEW_SOURCES = 64

# A landed registry: a table with its input order in ``_ord``, or nothing.
Landed = Mapping[str, DataFrame | None]


def harmonise_registry(raw: DataFrame, spec: RegistrySpec, first_row: int = 0) -> DataFrame:
    """One raw dictionary as store rows (without vector), input order kept.

    ``first_row`` is the number of the first row, for registries whose ids may
    be row numbers and that land in several batches.

    The order of steps matters: nulls are filled before duplicates are dropped,
    so all rows with a null key become one row.  A cap, where a spec sets one,
    comes last; no spec of the package does.
    """
    df = H.detect_columns(raw) if spec.detect else H.rename_columns(raw, spec.rename)
    df = H.backfill_missing_columns(df, spec.backfill)
    carried = [*spec.columns, ORD]
    if spec.needs_row_index:
        df = number_rows(df, ROW_INDEX).withColumn(ROW_INDEX, F.col(ROW_INDEX) + F.lit(first_row))
        carried.append(ROW_INDEX)
    df = H.project_canonical(df, carried)
    if spec.fill is None:
        df = H.fill_blank(df, spec.columns)
    else:
        df = H.fill_defaults(df, spec.fill)
    if spec.language:
        df = H.filter_language(df, spec.language)
    if spec.dedup:
        df = dedup_keep_first(df, [spec.dedup])
    if spec.cap:
        df = cap_rows(df, spec.cap)
    return df.select(
        X.render(spec.id).alias("id"),
        F.lit(spec.source).alias("source"),
        X.field_expr(spec.indicator).alias("indicator_id"),
        X.field_expr(spec.short_name).alias("short_name"),
        X.render(spec.document).alias("document"),
        H.metadata_map(spec.source, spec.metadata).alias("metadata"),
        ORD,
    )


def landed_or_fallback(
    spark: SparkSession, spec: RegistrySpec, raw: DataFrame | None
) -> DataFrame | None:
    """The landed table, or what the registry's policy puts in its place."""
    if raw is not None:
        return raw
    if spec.on_missing == "seed":
        return seed_rows(spark, spec.seed)
    if spec.on_missing == "skip":
        return None
    raise FileNotFoundError(f"registry {spec.key!r} has not landed")


def _place(rows: DataFrame, position: int) -> Column:
    """A comparable place for every scan: registry, file, block, row and item; a plain number stands for the row."""
    kind = rows.schema[ORD].dataType
    fields = set(kind.names) if isinstance(kind, T.StructType) else set()

    def part(name: str, otherwise: Column, cast: str) -> Column:
        return (F.col(f"{ORD}.{name}") if name in fields else otherwise).cast(cast).alias(name)

    return F.struct(
        F.lit(position).alias("registry"),
        part("file", F.lit(""), "string"),
        part("block", F.lit(0), "long"),
        part("seq", F.lit(0) if fields else F.col(ORD), "long"),
        part("item", F.lit(0), "long"),
    )


def harmonise(
    spark: SparkSession,
    landed: Landed,
    specs: Mapping[str, RegistrySpec],
    keys: Iterable[str] = ("all",),
    keep_order: bool = False,
) -> DataFrame:
    """All chosen registries as one lazy table of store rows.

    With ``keep_order`` the rows keep their input order in ``_ord``: the
    position of the registry, then their place in it.
    """
    frames = []
    for position, (key, spec) in enumerate(select_specs(specs, keys).items()):
        raw = landed_or_fallback(spark, spec, landed.get(key))
        if raw is not None:
            rows = harmonise_registry(raw, spec)
            frames.append(rows.withColumn(ORD, _place(rows, position)) if keep_order else rows.drop(ORD))
    if not frames:
        raise ValueError("no registry has anything to harmonise")
    return H.union_registries(frames)


def harmonise_unified(landed: Landed, specs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Raw dictionaries in the unified five columns with their composite text."""
    specs = specs or fixed.UNIFIED_REGISTRIES
    frames = [H.to_unified(df, specs[key]) for key, df in landed.items() if df is not None]
    return H.add_composite_text(H.union_registries(frames))


def embed_corpus(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    encoder: EncoderFactory | None = None,
    batch_size: int = fixed.ENCODE_BATCH,
    sources: Iterable[str] | None = None,
) -> None:
    """Embed new or changed documents and upsert them into the store.

    ``rows`` carry their input order in ``_ord``, by which the last row of an
    id wins; only that one is compared with the store and encoded.  ``sources``
    only says which folders hold what the rows may be equal to; the folders
    that are rewritten always follow from the batch, so that none loses rows.
    Rows are staged in the shared folder without vectors, which are many times
    their size: these are made once, by the tasks that write the store.  Where
    few ``sources`` are named, rows are staged as these tasks read them, so
    that beside the growing store there is no shuffle of all rows.
    """
    if ORD not in rows.columns:
        raise ValueError(f"embed_corpus needs the input order of its rows in {ORD}")
    changed = dedup_keep_last(rows, ["id"]).drop(ORD)
    sources = None if sources is None else list(sources)
    if path_exists(spark, path):
        among = F.col("source").isin(sources) if sources else touched_sources(rows)
        changed = changed_documents(changed, scan_vector_store(spark, path).where(among))

    def encode(some: DataFrame) -> DataFrame:
        return add_hash_vector(some) if encoder is None else model_embed(some, encoder, batch_size=batch_size)

    staged = fresh_path(spark, "changed")
    try:
        write = changed.write.option("compression", "zstd")
        dealt = sources is not None and len(sources) <= FEW_SOURCES
        if dealt:
            write = write.option("maxRecordsPerFile", VECTOR_ROWS).partitionBy("source")
        write.parquet(staged)
        upsert_encoded(spark, path, spark.read.schema(changed.schema).parquet(staged), encode, dealt)
    finally:
        discard(spark, staged)


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], None]) -> bool:
    """Run ``build`` when the store is absent or empty; tell whether it ran."""
    if path_exists(spark, path) and scan_vector_store(spark, path).limit(1).count():
        return False
    build()
    return True


def run_ingest(
    spark: SparkSession,
    readers: Mapping[str, Callable[[], DataFrame | None]],
    specs: Mapping[str, RegistrySpec],
    path: str,
    keys: Iterable[str] = ("all",),
    encoder: EncoderFactory | None = None,
    batch_size: int = fixed.ENCODE_BATCH,
    batch: int | None = None,
) -> DataFrame:
    """Ingest registries one after another; a failing one does not stop the rest.

    Returns one report row per registry.  The loop runs over registries, each
    of which is one distributed write.  Registries whose ids may be row
    numbers go on counting from run to run, by a ledger beside the store;
    ``batch`` repeats a run of that number instead of starting the next.
    """
    run = uuid.uuid4().hex
    report = []
    for key, spec in select_specs(specs, keys).items():
        started = time.monotonic()
        status, error, n_rows = "ok", None, 0
        try:
            reader = readers.get(key)
            raw = landed_or_fallback(spark, spec, reader() if reader else None)
            if raw is not None:
                counted = Observation()
                ledger = RowLedger(spark, f"{path}-rows/{key}") if spec.needs_row_index else None
                if ledger:
                    number = ledger.next_batch() if batch is None else batch
                    # Committed first: a run that fails later leaves a gap, never numbers given twice.
                    first = ledger.rows_before(number)
                    ledger.commit(number, raw.count())
                rows = harmonise_registry(raw, spec, first if ledger else 0).observe(
                    counted, F.count(F.lit(1)).alias("n_rows")
                )
                embed_corpus(spark, rows, path, encoder, batch_size, [spec.source])
                n_rows = counted.get["n_rows"]
        except Exception as failure:  # noqa: BLE001 - reported, not swallowed
            status, error = "failed", str(failure)
        report.append((run, key, status, error, n_rows, time.monotonic() - started))
    return spark.createDataFrame(report, REPORT_SCHEMA)
