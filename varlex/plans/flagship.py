"""Two registries to ranked context blocks in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.operators.context import context_block
from varlex.operators.embed import add_hash_vector, spread_for_vectors
from varlex.operators.harmonise import union_registries
from varlex.plans.ingest import harmonise
from varlex.plans.registered import roles as R
from varlex.plans.search import embed_queries, search
from varlex.specs import HASH_SPECS


def context_for_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonise documents and parts, embed, search every benchmark text, rerank."""
    parts = R.allofus_hash_raw(spark, sf_dir)
    documents = harmonise(spark, {"usaid": R.usaid_raw(spark, sf_dir)}, HASH_SPECS, ["usaid"])
    # Parts are a few bytes each, so that all of them may come to one task once repeated ids are gone.
    concepts = spread_for_vectors(
        harmonise(spark, {"nih_allofus": parts}, HASH_SPECS, ["nih_allofus"]), "id", counted=parts
    )
    store = add_hash_vector(union_registries([documents, concepts]))
    queries = embed_queries(
        R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    )
    # Hash vectors of different texts are nearly orthogonal: squared distance about 2.
    return context_block(search(queries, store, n=5, max_dist=2.0), queries=queries)
