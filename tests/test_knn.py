"""Nearest neighbours against brute force, with copies, ties and filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlex.operators import knn
from varlex.operators.embed import add_hash_vector, spread_for_vectors
from varlex.operators.knn import knn_join
from varlex.plans.search import embed_queries

DIM, N, Q, K = 8, 900, 40, 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(N, DIM)).astype(np.float32)
    corpus[::3] = corpus[0]  # a third of the corpus are copies
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    queries = rng.normal(size=(Q, DIM))
    queries[:5] = corpus[0]  # the copies are the nearest rows of these
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    sources = [None if i % 10 == 0 else f"s{i % 4}" for i in range(N)]
    allowed = [None if q % 3 == 0 else [f"s{q % 4}"] if q % 3 == 1 else ["s1", "s2"] for q in range(Q)]
    return corpus, queries, sources, allowed


@pytest.fixture(scope="module")
def frames(spark, data):
    corpus, queries, sources, allowed = data
    c = spark.createDataFrame(
        [(f"v{i}", corpus[i].tolist(), sources[i], i % 6) for i in range(N)],
        "id string, vector array<float>, source string, cell int",
    ).repartition(5)
    q = spark.createDataFrame(
        [(i, queries[i].tolist(), allowed[i]) for i in range(Q)],
        "query_id long, vector array<double>, allowed array<string>",
    )
    return q, c


def brute(data, metric="l2sq", filtered=False, k=K):
    corpus, queries, sources, allowed = data
    result = set()
    for q in range(Q):
        scored = []
        for i in range(N):
            if filtered and allowed[q] is not None and sources[i] not in allowed[q]:
                continue
            x, y = queries[q], corpus[i].astype(float)
            value = ((x - y) ** 2).sum() if metric == "l2sq" else -(x * y).sum()
            scored.append((round(value, 6) + 0.0, f"v{i}"))
        for rank, (value, name) in enumerate(sorted(scored)[:k], 1):
            result.add((q, rank, name, round(abs(value) if metric == "l2sq" else -value, 6) + 0.0))
    return result


def got(df):
    return {tuple(r) for r in df.collect()}


PLANS = {
    "broadcast": {},
    "blocks": {"max_broadcast_queries": 3, "block_rows": 100, "query_block_rows": 7},
    "lanes": {"lanes": 3},
    "merged scan": {"scan_tasks": 2},
}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("metric", ["l2sq", "dot"])
def test_equals_brute_force(frames, data, plan, metric):
    q, c = frames
    assert got(knn.knn_join(q, c, K, metric, **PLANS[plan])) == brute(data, metric)


@pytest.mark.parametrize("plan", PLANS)
def test_filter_acts_before_top_k_and_null_sources_need_no_filter(frames, data, plan):
    q, c = frames
    found = got(knn.knn_join(q, c, K, where={"source": "allowed"}, **PLANS[plan]))
    assert found == brute(data, filtered=True)


def test_small_kernel_blocks_do_not_change_the_answer(frames, data, monkeypatch):
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 300)
    q, c = frames
    assert got(knn.knn_join(q, c, 30)) == brute(data, k=30)


def test_fewer_rows_than_k_and_no_queries(spark, frames):
    q, c = frames
    few = c.where("id in ('v1', 'v2')")
    assert knn.knn_join(q, few, K).count() == 2 * Q
    assert knn.knn_join(q.where("query_id < 0"), c, K).count() == 0
    assert knn.knn_join(q, c.where("id = 'none'"), K).count() == 0


def test_payload_and_carried_columns(frames, data):
    q, c = frames
    named = q.withColumn("query", F.concat(F.lit("q"), "query_id"))
    for options in (PLANS["broadcast"], PLANS["blocks"]):
        rows = knn.knn_join(named, c, K, payload=["source"], carry=["query"], **options).collect()
        assert len(rows) == Q * K
        assert all(r["query"] == f"q{r['query_id']}" for r in rows)
        assert all(r["source"] == data[2][int(r["id"][1:])] for r in rows)


def test_corpus_is_not_shuffled(spark, frames, tmp_path):
    q, c = frames
    path = str(tmp_path / "store")
    c.write.partitionBy("source").parquet(path)
    stored = spark.read.parquet(path)
    plan = knn.knn_join(q, stored, K)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert "Exchange" not in below and "WindowGroupLimit" in plan
    one = q.withColumn("allowed", F.array(F.lit("s1")))
    pruned = knn.knn_join(one, stored, K, where={"source": "allowed"})
    partition_filters = pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert "source" in partition_filters.split("]")[0]


def test_approximate_search(spark, frames, data):
    q, c = frames
    corpus = c.drop("cell")
    model = knn.fit_cells(corpus, 6)
    cells = knn.assign_cells(corpus, model)
    assert cells.count() == N
    exact = brute(data)
    assert got(knn.approx_knn(q, cells, model, K, nprobe=6)) == exact
    # Copies tie, so recall is counted on distances.
    wanted = {}
    for query, rank, _, distance in exact:
        wanted.setdefault(query, []).append(distance)
    recalls = []
    for nprobe in (1, 2, 4, 6):
        found = knn.approx_knn(q, cells, model, K, nprobe, **PLANS["blocks" if nprobe == 4 else "broadcast"])
        hits = sum(1 for r in found.collect() if r["distance"] <= max(wanted[r["query_id"]]))
        recalls.append(hits)
    assert recalls == sorted(recalls) and recalls[-1] == Q * K


def test_built_in_scores_agree_with_the_kernel(frames, data):
    q, c = frames
    found = knn.knn_join(q, c, K, payload=["vector"])
    pairs = found.join(q.select("query_id", F.col("vector").alias("left")), "query_id").select(
        "query_id", "id", F.col("distance").alias("expected"), "left", F.col("vector").alias("right"))
    assert knn.pair_scores(pairs).where(F.abs(F.col("expected") - F.col("distance")) > 1e-6).count() == 0


def test_blocks_grow_with_the_table(frames, data):
    q, c = frames
    cores = q.sparkSession.sparkContext.defaultParallelism
    for n in (900, 90_000, 900_000):
        rows, queries = knn.block_sizes([n], [n], 256, 256, cores)
        assert rows <= knn.BLOCK_ROWS and queries <= knn.QUERY_BLOCK_ROWS
        full = -(-n // knn.BLOCK_ROWS) * -(-n // knn.QUERY_BLOCK_ROWS)
        assert -(-n // rows) * -(-n // queries) <= max(full, knn.MEETINGS_PER_CORE * cores)
    # Blocks that are asked to be larger than the limit stay as they are.
    assert knn.block_sizes([10], [10], 1 << 20, 1 << 20, cores) == (1 << 20, 1 << 20)
    # Blocks of one row each would send every row 940 times.
    found = knn.knn_join(q, c, K, max_broadcast_queries=0, block_rows=1, query_block_rows=1)
    assert got(found) == brute(data)


@pytest.mark.parametrize("plan", ["broadcast", "blocks"])
def test_candidates_may_be_merged_at_any_time(frames, data, monkeypatch, plan):
    q, c = frames
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", 300)
    for rows in (1, 1 << 20):
        monkeypatch.setattr(knn, "MERGE_ROWS", rows)
        assert got(knn.knn_join(q, c, K, **PLANS[plan])) == brute(data)


def test_computed_vectors_are_drawn_once_and_missing_ones_match_nothing(spark):
    corpus = add_hash_vector(spark.createDataFrame([(str(k), f"t{k}" if k % 3 else None) for k in range(30)], "id string, document string"))
    queries = embed_queries(spark.createDataFrame([(1, "t4"), (2, "other")], "query_id long, query string"))
    for filters in ({}, {"max_broadcast_queries": 0}):
        found = knn_join(queries, corpus, 30, **filters)
        rows = found.collect()
        assert {(r["query_id"], int(r["id"])) for r in rows} == {(q, k) for q in (1, 2) for k in range(30) if k % 3}
        assert [r["id"] for r in rows if r["query_id"] == 1 and r["vector_rank"] == 1] == ["4"]
        if not filters:
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("ArrowEvalPython") == 1


def test_many_short_rows_are_spread_by_their_number(spark):
    rows = spark.range(9_000).coalesce(1)
    tasks = spread_for_vectors(rows, "id").rdd.getNumPartitions()
    assert tasks == min(3, spark.sparkContext.defaultParallelism) > 1
    few = spark.range(100).coalesce(1)
    assert spread_for_vectors(few, "id").rdd.getNumPartitions() == 1
    assert spread_for_vectors(few, "id", counted=rows).rdd.getNumPartitions() == tasks
    assert sorted(r["id"] for r in spread_for_vectors(rows, "id").collect()) == list(range(9_000))
