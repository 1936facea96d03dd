"""Second-stage scoring of search candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlex.functions.text import pair_text, word_overlap

# A factory runs once per Python task: (queries, candidate texts) -> scores.
ScorerFactory = Callable[[], Callable[[list[str], list[str]], list[float]]]


def rerank(
    candidates: DataFrame, query: str = "query", scorer: ScorerFactory | None = None
) -> DataFrame:
    """Score every (query, candidate) pair and rank per query, best first.

    Without a scorer the built-in word overlap is used, which stays in the JVM.
    A scorer model is loaded once per Python task and sees Arrow batches.  Equal
    scores keep the order of ``vector_rank``.  No candidates in, none out.
    """
    if scorer is None:
        score = word_overlap(query, pair_text())
    else:
        def score_pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = scorer()
            for asked, texts in batches:
                yield pd.Series(model(asked.tolist(), texts.tolist()), dtype="float64")

        score = F.pandas_udf(score_pairs, "double")(F.col(query), pair_text())
    order = Window.partitionBy("query_id").orderBy(
        F.col("rerank_score").desc(), F.col("vector_rank").asc()
    )
    return candidates.withColumn("rerank_score", score).withColumn(
        "final_rank", F.row_number().over(order)
    )


def keep_best(ranked: DataFrame, n: int | str, rank: str = "final_rank") -> DataFrame:
    """The first n candidates of every query; ``n`` is a number or a column."""
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    return ranked.where(F.col(rank) <= limit)
