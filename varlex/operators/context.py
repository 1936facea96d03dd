"""Exports, context blocks and prompts built from final matches.

Every group below is one query's final matches, at most ``n`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlex import fixed


def export_records(matches: DataFrame) -> DataFrame:
    """Final matches as records; missing text becomes an empty string."""
    blank = {
        c: F.coalesce(F.col(c), F.lit(""))
        for c in ("source_dataset", "table_id", "variable_id", "description")
    }
    return matches.select(
        "query_id", "final_rank", *[value.alias(name) for name, value in blank.items()]
    )


def _for_every_query(found: DataFrame, queries: DataFrame | None, column: str, empty: Column) -> DataFrame:
    """``found`` with a row for each of ``queries``; those without a match get the empty value."""
    if queries is None:
        return found
    joined = queries.select("query_id").join(found, "query_id", "left")
    return joined.select("query_id", F.coalesce(column, empty).alias(column))


def target_ids(matches: DataFrame, rank: str = "final_rank", queries: DataFrame | None = None) -> DataFrame:
    """Non-empty variable ids of every query in rank order, repeats kept.

    With ``queries`` (``query_id``) those without any get an empty list.
    """
    found = (
        matches.where(F.col("variable_id") != "")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct(rank, "variable_id"))).alias("_ranked"))
        .select(
            "query_id", F.transform("_ranked", lambda r: r["variable_id"]).alias("target_ids")
        )
    )
    return _for_every_query(found, queries, "target_ids", F.array().cast("array<string>"))


def context_block(matches: DataFrame, rank: str = "final_rank", queries: DataFrame | None = None) -> DataFrame:
    """One text per query: numbered matches with source, code and description.

    With ``queries`` (``query_id``) those without a match get an empty text.
    """
    block = F.concat(
        F.lit("[Match #"), F.col(rank).cast("string"),
        F.lit(" | Source: "), F.coalesce("source_dataset", F.lit(fixed.NOT_AVAILABLE)),
        F.lit(" | Code: "), F.coalesce("variable_id", F.lit(fixed.NOT_AVAILABLE)),
        F.lit("]\n"), F.coalesce("description", F.lit("")),
    )
    found = (
        matches.select("query_id", rank, block.alias("_block"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct(rank, "_block"))).alias("_ranked"))
        .select(
            "query_id",
            F.array_join(
                F.transform("_ranked", lambda r: r["_block"]), fixed.CONTEXT_SEPARATOR
            ).alias("context"),
        )
    )
    return _for_every_query(found, queries, "context", F.lit(""))


def build_prompt(queries: DataFrame, contexts: DataFrame, registers: str = "registers") -> DataFrame:
    """System and user prompt of every query; no match gives an empty context."""
    before, rest = fixed.PROMPT_TEMPLATE.split("{context}")
    between, after = rest.split("{query}")
    user = F.concat(
        F.lit(before), F.coalesce("context", F.lit("")), F.lit(between), F.col("query"), F.lit(after)
    )
    return queries.join(contexts, "query_id", "left").select(
        "query_id",
        F.lit(fixed.SYSTEM_PROMPT.format(registers=registers)).alias("system_prompt"),
        user.alias("user_prompt"),
    )
