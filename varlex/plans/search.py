"""Search a table of queries against the store, end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions import text as X
from varlex.functions.vectors import hash_embed
from varlex.operators.knn import knn_join, similarity
from varlex.operators.report import count_sources
from varlex.operators.rerank import ScorerFactory, keep_best, rerank


def source_filter(sources: Column | str, available: int) -> Column:
    """Allowed sources of a query; null (no filter) if none or all are selected."""
    chosen = F.col(sources) if isinstance(sources, str) else sources
    partial = (F.size(chosen) > 0) & (F.size(chosen) < available)
    return F.when(partial, chosen)


def distance_threshold(candidates: DataFrame, max_dist: Column | float) -> DataFrame:
    """Cut the result of the top-k search at a distance."""
    limit = max_dist if isinstance(max_dist, Column) else F.lit(float(max_dist))
    return candidates.where(F.col("distance") <= limit)


def resolve_metadata(candidates: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Source, table, variable and name of a candidate from its metadata keys."""
    return candidates.withColumns(
        {
            "source_dataset": X.resolve_keys(metadata, ("source",), fixed.UNKNOWN_SOURCE),
            "table_id": X.resolve_keys(metadata, *fixed.RESOLVE_TABLE),
            "variable_id": X.resolve_keys(metadata, *fixed.RESOLVE_VARIABLE),
            "variable_name": X.resolve_keys(metadata, *fixed.RESOLVE_NAME),
        }
    )


def embed_queries(queries: DataFrame, dim: int = fixed.EMBED_DIM) -> DataFrame:
    """Double-precision hash vectors of the query texts."""
    return queries.withColumn("vector", hash_embed("query", dim, double=True))


def search(
    queries: DataFrame,
    store: DataFrame,
    n: int = fixed.DEFAULT_RESULTS,
    max_dist: float = fixed.DEFAULT_MAX_DISTANCE,
    scorer: ScorerFactory | None = None,
    available_sources: int | None = None,
    **knn_options,
) -> DataFrame:
    """Final matches of every query, ranked.

    ``queries``: ``query_id, query, vector`` and optionally ``sources`` (array),
    ``max_dist`` and ``n`` per query.  ``store``: store rows with ``vector``.
    Steps: source filter, 2n nearest, distance cut, similarity, metadata,
    rerank, first n.  Only ids and vectors take part in the nearest-neighbour
    scan; documents are joined back for the few winners.
    """
    per_query_n = "n" in queries.columns
    # The over-fetch has to reach for the query that wants most.
    most = (queries.agg(F.max("n")).first()[0] or 0) if per_query_n else n
    where = None
    if "sources" in queries.columns:
        if available_sources is None:
            available_sources = count_sources(store).first()["n_sources"]
        queries = queries.withColumn("_allowed", source_filter("sources", available_sources))
        where = {"source": "_allowed"}
    wanted = F.col("n") if per_query_n else F.lit(n)
    limit = F.col("max_dist") if "max_dist" in queries.columns else F.lit(float(max_dist))
    candidates = (
        knn_join(
            queries.withColumns({"_n": wanted, "_max_dist": limit}),
            store,
            fixed.OVERFETCH * most,
            "l2sq",
            where,
            payload=["indicator_id", "metadata", "document"],
            carry=["query", "_n", "_max_dist"],
            **knn_options,
        )
        .where(F.col("vector_rank") <= F.col("_n") * fixed.OVERFETCH)
        .transform(distance_threshold, F.col("_max_dist"))
        .withColumn("vector_score", similarity())
        .withColumnRenamed("document", "description")
    )
    # A registry's own code is what observation look-ups need.
    described = candidates.transform(resolve_metadata).withColumn(
        "variable_id", F.coalesce("indicator_id", "variable_id")
    )
    # Both cuts remove the tail of the ranking, so vector_rank is still the
    # position by descending similarity and needs no second sort.
    return keep_best(rerank(described, "query", scorer), "_n").select(
        "query_id", "query", "final_rank", "rerank_score", "vector_rank", "vector_score",
        "distance", "id", "source_dataset", "table_id", "variable_id", "variable_name", "description",
    )
