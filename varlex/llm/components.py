"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlex.llm.common import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """One row (node, component) for every node that is not the smallest of its component.

    ``links`` has two comparable columns ``a`` and ``b``; order, repeats and
    self links don't matter; null ends are ignored.  The component is its
    smallest node, which has no row of its own.  Alternating large-star and
    small-star rounds replace the edges until they no longer change; the
    number of rounds grows with the logarithm of the graph's size.  Minima are
    combined before they are shuffled, and the joins back to the edges are
    plain equi-joins whose hot keys adaptive execution splits.  Every round is
    written to the shared checkpoint folder.
    """
    edges = durable(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b").distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(lower.select("u", F.col("m").alias("v")))
        following = durable(small.distinct())
        after = _state(following)
        edges = following
        if after == state:
            break
        state = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
