"""

One warm-up and three runs per figure, median; results go to the no-op sink.
"""

from __future__ import annotations

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from varlex.operators import knn  # noqa: E402
from varlex.operators.embed import add_hash_vector  # noqa: E402
from varlex.operators.harmonise import union_registries  # noqa: E402
from varlex.operators.ordering import ORD  # noqa: E402
from varlex.plans import registered  # noqa: E402
from varlex.plans.ingest import harmonise_registry  # noqa: E402
from varlex.plans.registered import roles as R  # noqa: E402
from varlex.session import fresh_path, local_session, tune  # noqa: E402
from varlex.sources import sinks  # noqa: E402
from varlex.specs import HASH_SPECS  # noqa: E402


def median(action) -> float:
    taken = []
    for _ in range(4):
        started = time.perf_counter()
        action()
        taken.append(time.perf_counter() - started)
    return statistics.median(taken[1:])


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def show(name: str, seconds: float, amount: float | None = None, unit: str = "") -> None:
    rate = f" {amount / seconds:,.0f} {unit}/s" if amount else ""
    print(f"{name}: {seconds:.2f} s{rate}", flush=True)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = tune(local_session(sys.argv[2] if len(sys.argv) > 2 else 4, "measure"))
    spark.sparkContext.setLogLevel("ERROR")

    # Six tables as one kind of dictionary: id, label, text.
    tables = {
        "documents": ("doc_id", "source", "text"), "part": ("p_partkey", "p_brand", "p_name"),
        "customer": ("c_custkey", "c_mktsegment", "c_name"), "supplier": ("s_suppkey", "s_name", "s_name"),
        "nation": ("n_nationkey", "n_name", "n_name"), "region": ("r_regionkey", "r_name", "r_name"),
    }
    frames = [
        R.table(spark, sf_dir, name).select(
            F.concat(F.lit(name), R.text(key)).alias("variable_id"), F.col(label).alias("sas_label"),
            F.col(text).alias("question_text"), F.col(key).cast("bigint").alias(ORD))
        for name, (key, label, text) in tables.items()
    ]
    n_rows = sum(f.count() for f in frames)
    spec = HASH_SPECS["nhanes"]
    show("harmonise", median(lambda: drain(union_registries(
        [harmonise_registry(f, spec).drop(ORD) for f in frames]))), n_rows, "rows")

    documents = R.table(spark, sf_dir, "documents")
    show("hash_embed", median(lambda: drain(add_hash_vector(documents, "text").select("doc_id", "vector"))),
         documents.count(), "texts")

    corpus = R.vectors(spark, sf_dir)
    n = corpus.count()
    queries = R.vector_queries(spark, sf_dir).where(F.col("query_id") < 200)
    path = fresh_path(spark, "replicated")
    for factor in (1, 10, 100):
        copies = f"{path}/{factor}"
        corpus.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).select(
            (F.col("id") + F.col("_copy") * n).alias("id"), "source", "vector"
        ).repartition(max(4, factor // 4)).write.parquet(copies)
        big = spark.read.parquet(copies)
        show(f"knn_join x{factor}", median(lambda: drain(knn.knn_join(queries, big, 10))), 200 * n * factor, "pairs")

    exact = {(r["query_id"], r["id"]) for r in knn.knn_join(queries, corpus, 10).collect()}
    model = knn.fit_cells(corpus, 32)
    cells = knn.assign_cells(corpus, model).select("id", "vector", "cell")
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    for nprobe in (1, 4, 8, 16, 32):
        found = {(r["query_id"], r["id"]) for r in knn.approx_knn(queries, cells, model, 10, nprobe).collect()}
        probed = knn.probe_cells(queries, model, nprobe).select(F.explode("cells").alias("cell"))
        scanned = sum(sizes.get(r["cell"], 0) * r["count"] for r in probed.groupBy("cell").count().collect())
        print(f"approx nprobe={nprobe}: recall {len(found & exact) / len(exact):.3f}, "
              f"scanned {scanned / (200 * n):.3f}", flush=True)

    rows = documents.select(
        R.text("doc_id").alias("id"), F.lit("s").alias("source"), R.text("doc_id").alias("indicator_id"),
        F.col("lang").alias("short_name"), F.col("text").alias("document"),
        F.array(F.lit(1.0).cast("float")).alias("vector"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"), F.col("doc_id").alias(ORD))
    store = fresh_path(spark, "store")
    sinks.upsert_by_id(spark, store, rows)
    tenth = rows.where(F.col(ORD) % 10 == 0).withColumn("document", F.lit("changed"))
    show("upsert_by_id, 10 % changed", median(lambda: sinks.upsert_by_id(spark, store, tenth)))

    for name in ("observations_for_matches", "search"):
        show(name, median(lambda: drain(registered.QUERIES[name](spark, sf_dir))))
    spark.stop()


if __name__ == "__main__":
    main()
