"""The cell index and the Voronoi join against brute force and exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlex.operators import cell_index, knn, voronoi
from varlex.session import fresh_path

K = 4


def frames(spark, clustered=True, n=1500, q=120, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dim)) * (6 if clustered else 0)
    corpus = (middles[rng.integers(12, size=n)] + rng.normal(size=(n, dim))).astype(np.float32)
    corpus[::3] = corpus[0]  # a third are copies
    asked = middles[rng.integers(12, size=q)] + rng.normal(size=(q, dim))
    asked[:3] = corpus[0]
    c = [(f"v{i}", None if i % 50 == 49 else corpus[i].tolist()) for i in range(n)]
    a = [(i, None if i % 40 == 39 else asked[i].tolist()) for i in range(q)]
    return (
        spark.createDataFrame(a, "query_id long, vector array<double>").repartition(3),
        spark.createDataFrame(c, "id string, vector array<float>").repartition(5),
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "vector_rank", "id", "distance").collect())


@pytest.fixture(scope="module")
def index(spark):
    queries, corpus = frames(spark)
    path = fresh_path(spark, "test-cells")
    early = F.xxhash64("id") % 3 != 0
    cell_index.write_index(spark, corpus.where(early), path, cells=12, parts=4, words=64)
    cell_index.add_rows(spark, corpus.where(~early), path)
    return path, queries, corpus


def test_all_cells_are_the_exact_search(spark, index):
    path, queries, corpus = index
    exact = rows(knn.knn_join(queries, corpus, K))
    assert rows(cell_index.search_cells(spark, path, queries, K, 12)) == exact
    assert rows(cell_index.search_codes(spark, path, queries, K, 12, keep=2000)) == exact
    assert rows(cell_index.search_codes(spark, path, queries, K, 12, keep=2000, block=50)) == exact


def test_codes_find_most_neighbours_with_exact_distances(spark, index):
    path, queries, corpus = index
    exact = {(r[0], r[2]): r[3] for r in rows(cell_index.search_cells(spark, path, queries, K, 3))}
    by_code = {(r[0], r[2]): r[3] for r in rows(cell_index.search_codes(spark, path, queries, K, 3))}
    shared = set(exact) & set(by_code)
    assert len(shared) >= 0.9 * len(exact)
    assert all(exact[pair] == by_code[pair] for pair in shared)


def test_the_first_of_equal_codes_are_kept():
    near = np.array([[2.0, 1.0, 1.0, 1.0, 0.0], [5.0, 5.0, 5.0, 5.0, 5.0]])
    assert cell_index._first_codes(near, 3).tolist() == [[False, True, True, False, True], [True, True, True, False, False]]
    assert cell_index._first_codes(near, 5).all() and cell_index._first_codes(near, 9).all()


def test_more_query_blocks_are_no_more_plans(spark, index, monkeypatch):
    path, queries, corpus = index
    whole = rows(cell_index.search_codes(spark, path, queries, K, 3))
    monkeypatch.setattr(cell_index, "BLOCK_ROWS", 40)
    many = cell_index.search_codes(spark, path, queries, K, 3, block=5)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    assert rows(many) == whole
    assert cell_index.search_codes(spark, path, queries.where("false"), K, 3).count() == 0


def test_only_probed_folders_are_read(spark, index):
    path, queries, corpus = index
    one = queries.where("query_id = 5")
    plan = cell_index.search_cells(spark, path, one, K, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    probing = cell_index.probed(one, spark.read.parquet(f"{path}/centres"), 2)
    stored = cell_index.index_rows(spark, path)
    assert {r["cell"] for r in cell_index._pruned(stored, probing).select("cell").distinct().collect()} == set(
        probing.first()["cells"]
    )


def test_recall_rises_with_the_rows_read(spark, index):
    path, queries, corpus = index
    report = cell_index.recall_by_cells(spark, path, queries, K, [1, 2, 12]).orderBy("nprobe").collect()
    assert [r["found"] for r in report] == sorted(r["found"] for r in report)
    assert report[-1]["found"] == report[-1]["wanted"] == 117 * K and report[-1]["rows_read"] == report[-1]["rows_all"]
    assert report[0]["rows_read"] < report[0]["rows_all"] / 3


def test_recall_searches_once_and_counts_what_searches_find(spark, index):
    path, queries, corpus = index
    report = cell_index.recall_by_cells(spark, path, queries, K, [1, 3])
    assert report._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    exact = {(r[0], r[2]) for r in rows(knn.knn_join(queries, corpus, K))}
    for line in report.collect():
        near = {(r[0], r[2]) for r in rows(cell_index.search_cells(spark, path, queries, K, line["nprobe"]))}
        assert (line["found"], line["wanted"]) == (len(exact & near), len(exact))


def test_an_index_is_not_overwritten(spark, index):
    with pytest.raises(FileExistsError):
        cell_index.write_index(spark, index[2], index[0])


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("pivots, block, query_block", [(1, 100, 30), (10, 200, 50), (40, 10_000, 10_000)])
def test_voronoi_is_the_exact_join(spark, clustered, pivots, block, query_block):
    queries, corpus = frames(spark, clustered)
    found = voronoi.knn_join_voronoi(queries, corpus, K, pivots, block, query_block, lanes=3)
    assert rows(found) == rows(knn.knn_join(queries, corpus, K))


def test_voronoi_with_few_rows(spark):
    queries, corpus = frames(spark, n=6, q=5)
    assert rows(voronoi.knn_join_voronoi(queries, corpus, 10)) == rows(knn.knn_join(queries, corpus, 10))
    nothing = corpus.where("false")
    assert voronoi.knn_join_voronoi(queries, nothing, 3).count() == 0
    assert voronoi.knn_join_voronoi(queries.where("false"), corpus, 3).count() == 0


def test_voronoi_moves_and_scores_less_than_the_grid(spark):
    queries, corpus = frames(spark, n=3000, q=600)
    costs = {r["plan"]: r for r in voronoi.join_costs(queries, corpus, K, 12, 300, 60).collect()}
    assert costs["voronoi"]["pairs_scored"] < costs["grid"]["pairs_scored"] / 2
    assert costs["voronoi"]["rows_shuffled"] < costs["grid"]["rows_shuffled"] / 2


def test_voronoi_sends_rows_to_few_blocks(spark):
    queries, corpus = frames(spark, clustered=False, n=1000, q=200)
    costs = {r["plan"]: r for r in voronoi.join_costs(queries, corpus, K, 4, 2, 2).collect()}
    # Nothing is pruned here: with blocks of two rows every row would go to a hundred or more.
    assert costs["voronoi"]["rows_shuffled"] < 1200 * 20
    assert rows(voronoi.knn_join_voronoi(queries, corpus, K, 4, 2, 2)) == rows(knn.knn_join(queries, corpus, K))
