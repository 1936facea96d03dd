"""Projections and clean-up that bring differently shaped dictionaries together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions import text as X
from varlex.operators.ordering import ORD, number_rows
from varlex.specs import ROW_INDEX

STORE_COLUMNS = ["id", "source", "indicator_id", "short_name", "document", "metadata"]


_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}
_TECHNICAL = {ORD, ROW_INDEX}


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def blank_na_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn the usual "no value" markers of delimited files into nulls."""
    names = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns(
        {c: F.when(~_quoted(c).isin(*fixed.NA_TOKENS), _quoted(c)) for c in names}
    )


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist, exact spelling only; ignore the rest."""
    return df.select(*[_quoted(c).alias(mapping.get(c, c)) for c in df.columns])


def fill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Replace nulls by the default of their column."""
    return df.withColumns(
        {c: F.coalesce(_quoted(c).cast("string"), F.lit(v)) for c, v in defaults.items() if c in df.columns}
    )


def fill_blank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast to text and replace every null by an empty string."""
    names = columns or [c for c in df.columns if c != ORD]
    return df.withColumns({c: F.coalesce(_quoted(c).cast("string"), F.lit("")) for c in names})


def backfill_missing_columns(
    df: DataFrame, columns: Sequence[str], default: str = ""
) -> DataFrame:
    """Add the columns that are absent, filled with a constant."""
    missing = {c: F.lit(default) for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def normalise_column_names(df: DataFrame) -> DataFrame:
    """Strip and lower every header."""
    return df.toDF(*[c if c == ORD else c.strip().lower() for c in df.columns])


def detect_columns(df: DataFrame) -> DataFrame:
    """Find the id and title columns of an unknown layout by their headers.

    Falls back to the first two columns, or to the row number and the only
    column.  The choice is made from the schema, not from the data.
    """
    df = normalise_column_names(df)
    names = [c for c in df.columns if c != ORD]
    keep = [ORD] if ORD in df.columns else []

    def first_with(hints):
        return next((c for c in names if any(h in c for h in hints)), None)

    identifier = first_with(fixed.ID_HEADER_HINTS)
    title = first_with(fixed.TITLE_HEADER_HINTS)
    if not (identifier and title):
        if len(names) < 2:
            df = number_rows(df, "_row")
            identifier, title = "_row", names[0]
        else:
            identifier, title = names[:2]
    return df.select(
        _quoted(identifier).cast("string").alias("field_id"),
        _quoted(title).cast("string").alias("title"),
        *keep,
    )


def project_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[_quoted(c) for c in columns if c in df.columns])


def project_canonical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the listed columns, numbers as text; a missing one is an error."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            _quoted(c).cast("string").alias(c) if kinds.get(c) in _NUMBERS and c not in _TECHNICAL else _quoted(c)
            for c in columns
        ]
    )


def tag_source(df: DataFrame, source: str, name: str = "source") -> DataFrame:
    """Constant source column."""
    return df.withColumn(name, F.lit(source))


def cast_string(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ids and labels as text."""
    return df.withColumns({c: _quoted(c).cast("string") for c in columns})


def filter_language(df: DataFrame, language: str, column: str = "Language") -> DataFrame:
    return df.where(_quoted(column) == language)


def metadata_map(source: str, fields: Mapping[str, str]) -> Column:
    """Key/value map of a registry; every value as text."""
    entries = [F.lit("source"), F.lit(source)]
    for key, expression in fields.items():
        entries += [F.lit(key), X.text_or_none(X.field_expr(expression))]
    return F.create_map(*entries)


def union_registries(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack harmonised registries by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def add_composite_text(df: DataFrame) -> DataFrame:
    return df.withColumn("composite_text", X.composite_text())


def enforce_unified_schema(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of the unified five-column schema.

    Rows without a source or a variable id are rejected, not an error.
    """
    typed = df.select(*[_quoted(c).cast("string").alias(c) for c in fixed.UNIFIED_COLUMNS])
    complete = F.col("source_dataset").isNotNull() & F.col("variable_id").isNotNull()
    return typed.where(complete), typed.where(~complete)


def to_unified(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """Map a raw dictionary to the unified five columns."""
    table = _quoted(spec["table_id"])
    if "table_prefix" in spec:
        table = X.prefix_concat(spec["table_prefix"], table)
    return df.select(
        F.lit(spec["source"]).alias("source_dataset"),
        table.cast("string").alias("table_id"),
        *[
            _quoted(spec[c]).cast("string").alias(c)
            for c in ("variable_id", "variable_name", "description")
        ],
    )


def unified_store_rows(unified: DataFrame) -> DataFrame:
    """Unified rows with composite text as store rows."""
    entries: list[Column] = []
    for name in fixed.UNIFIED_COLUMNS:
        entries += [F.lit(name), X.text_or_none(name)]
    return unified.select(
        X.render(fixed.UNIFIED_ID).alias("id"),
        F.col("source_dataset").alias("source"),
        F.col("variable_id").alias("indicator_id"),
        F.col("variable_name").alias("short_name"),
        F.col("composite_text").alias("document"),
        F.create_map(*entries).alias("metadata"),
    )
