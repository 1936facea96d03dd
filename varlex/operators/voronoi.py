"""Exact nearest neighbours of a large table in a large table, by Voronoi cells and the triangle inequality.

Pivots divide both sides into cells.  From the distances of rows to their own
pivot follows how far the k-th neighbour of a query can be, and so which cells
of the corpus it has to meet; rows that no query of a cell can reach aren't
sent there.  Cells of many rows are dealt out over blocks, as large as memory
and the number of cores allow; a query block and a corpus block meet in one task, which hands on its best k
rows for each query, and these are merged in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlex.operators.cell_index import fitting_sample
from varlex.operators.knn import BLOCK_ROWS, QUERY_BLOCK_ROWS, _arrow_type, _Best, _load_queries, _matrix, block_sizes
from varlex.operators.ordering import first_n

PIVOTS = 64
# Squared distances that agree in six digits are ties, so bounds give way by more than that.
SLACK = 2e-3
MERGE_LANES = 8


@dataclass
class Cells:
    """What the driver knows of the cells: a few numbers for each pivot."""

    pivots: np.ndarray
    apart: np.ndarray  # distances between pivots
    radius: np.ndarray  # of the corpus rows of a cell; -1 where there are none
    nearest: np.ndarray  # the k smallest distances of corpus rows to each pivot, inf where there are fewer
    blocks: np.ndarray  # corpus blocks of each cell
    reach: np.ndarray  # of the queries of a cell, how far their k-th neighbour can be
    query_radius: np.ndarray
    query_blocks: np.ndarray

    @property
    def first_block(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    @property
    def first_query_block(self) -> np.ndarray:
        return np.cumsum(self.query_blocks) - self.query_blocks


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] - 2.0 * vectors @ points.T + (points**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares, 0.0))


def pivot_rows(corpus: DataFrame, pivots: int) -> np.ndarray:
    """Different vectors of a bounded sample, spread out: each next one is the farthest from those before."""
    sample = _matrix(fitting_sample(corpus, 32 * pivots).select(F.col("vector").cast("array<double>")).toArrow().column("vector"))
    if not len(sample):
        return sample
    chosen, gap = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < pivots and gap.max() > SLACK:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def located(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with their cell and the distance to its pivot."""

    def nearest(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.struct([("cell", pa.int32()), ("gap", pa.float64())]))
        gaps = distances(_matrix(vectors).astype(np.float64), pivots)
        cell = gaps.argmin(axis=1)
        found = gaps[np.arange(len(cell)), cell]
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(found)], ["cell", "gap"])

    placed = rows.withColumn("_place", F.arrow_udf(nearest, "struct<cell:int,gap:double>")("vector"))
    return placed.select(*rows.columns, "_place.cell", "_place.gap")


def kth_bound(gap: np.ndarray, cell_distance: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """How far the k-th neighbour can be, for queries at ``gap`` from pivots with these distances to all others.

    A corpus row is no farther than the way over both pivots.
    """
    found = np.empty(len(gap))
    for start in range(0, len(gap), 512):
        some = cell_distance[start : start + 512]
        ways = (some[:, :, None] + nearest[None, :, :]).reshape(len(some), -1)
        found[start : start + 512] = np.partition(ways, k - 1, axis=1)[:, k - 1]
    return gap + found


def survey(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, k: int, block_rows: int, query_block_rows: int) -> Cells:
    """One aggregate over each located side; k + 2 numbers for each pivot reach the driver."""
    n = len(pivots)
    apart = distances(pivots, pivots)
    blocks, radius, nearest = np.zeros(n, np.int64), np.full(n, -1.0), np.full((n, k), np.inf)
    of_rows = corpus.groupBy("cell").agg(F.count("*").alias("rows"), F.max("gap").alias("radius")).collect()
    of_queries = queries.groupBy("cell").agg(F.count("*").alias("rows"), F.max("gap").alias("radius")).collect()
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    block_rows, query_block_rows = block_sizes(
        [r["rows"] for r in of_rows], [r["rows"] for r in of_queries], block_rows, query_block_rows, cores
    )
    for row in of_rows:
        blocks[row["cell"]], radius[row["cell"]] = -(-row["rows"] // block_rows), row["radius"]
    # Only the k nearest rows of a cell are ranked behind the shuffle.
    for row in first_n(corpus.select("cell", "gap"), k, ["cell"], [F.col("gap").asc()], "place").collect():
        nearest[row["cell"], row["place"] - 1] = row["gap"]
    query_blocks, query_radius, reach = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for row in of_queries:
        cell = row["cell"]
        query_blocks[cell], query_radius[cell] = -(-row["rows"] // query_block_rows), row["radius"]
        reach[cell] = kth_bound(np.array([row["radius"]]), apart[cell : cell + 1], nearest, k)[0]
    return Cells(pivots, apart, radius, nearest, blocks, reach, query_radius, query_blocks)


def cells_of_query(cells: Cells, cell: np.ndarray, gap: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Which corpus cells (columns) each query (rows) has to meet."""
    to_pivot = distances(vectors, cells.pivots)
    # Over its own distances to all pivots a query knows better than over its cell.
    bound = np.minimum(
        kth_bound(np.zeros(len(gap)), to_pivot, cells.nearest, k), kth_bound(gap, cells.apart[cell], cells.nearest, k)
    )
    return (cells.radius >= 0)[None, :] & (to_pivot - cells.radius[None, :] <= bound[:, None] + SLACK)


def cells_of_row(cells: Cells, cell: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Which query cells (columns) each corpus row (rows) may be among the nearest of."""
    least = cells.apart[cell] - cells.query_radius[None, :] - gap[:, None]
    lower = np.maximum(least, gap[:, None] - cells.apart[cell] - cells.query_radius[None, :])
    return (cells.query_blocks > 0)[None, :] & (lower <= cells.reach[None, :] + SLACK)


def _pairs(wanted: np.ndarray, blocks: np.ndarray, first: np.ndarray) -> pa.Array:
    """The block numbers of the wanted cells of each row."""
    row, cell = np.nonzero(wanted)
    times = blocks[cell]
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    numbers = np.repeat(first[cell], times) + inside
    stops = np.cumsum(np.bincount(row, weights=times, minlength=len(wanted))).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(numbers.astype(np.int32)))


def _meetings(queries: DataFrame, corpus: DataFrame, cells: Cells, k: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (query block, corpus block), once for each block they are sent to."""
    # A meeting takes place if the query cell and the corpus cell want each other.
    pair_of_cells = (cells.apart - cells.query_radius[:, None] - np.maximum(cells.radius, 0)[None, :]) <= cells.reach[:, None] + SLACK

    def of_query(cell: pa.Array, gap: pa.Array, vectors: pa.Array) -> pa.Array:
        if not len(cell):
            return pa.array([], pa.list_(pa.int32()))
        own = np.asarray(cell)
        wanted = cells_of_query(cells, own, np.asarray(gap), _matrix(vectors).astype(np.float64), k) & pair_of_cells[own]
        return _pairs(wanted, cells.blocks, cells.first_block)

    def of_row(cell: pa.Array, gap: pa.Array) -> pa.Array:
        if not len(cell):
            return pa.array([], pa.list_(pa.int32()))
        own = np.asarray(cell)
        return _pairs(cells_of_row(cells, own, np.asarray(gap)) & pair_of_cells.T[own], cells.query_blocks, cells.first_query_block)

    def block(name: str, counts: np.ndarray, first: np.ndarray):
        table = F.array(*[F.struct(F.lit(int(c)).alias("n"), F.lit(int(f)).alias("first")) for c, f in zip(counts, first)])
        own = F.get(table, F.col("cell"))
        return (own["first"] + F.pmod(F.xxhash64(name), F.greatest(own["n"], F.lit(1)))).cast("int")

    left = corpus.withColumn("_c", block("id", cells.blocks, cells.first_block)).withColumn(
        "_q", F.explode(F.arrow_udf(of_row, "array<int>")("cell", "gap"))
    )
    right = queries.withColumn("_q", block("query_id", cells.query_blocks, cells.first_query_block)).withColumn(
        "_c", F.explode(F.arrow_udf(of_query, "array<int>")("cell", "gap", "vector"))
    )
    return left.drop("gap"), right.drop("gap")


def _prepared(queries: DataFrame, corpus: DataFrame, k: int, pivots: int, block_rows: int, query_block_rows: int):
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = corpus.where(F.col("vector").isNotNull()).select("id", "vector")
    points = pivot_rows(rows, pivots)
    if not len(points):
        return asked, rows, None
    asked, rows = located(asked, points), located(rows, points)
    return asked, rows, survey(asked, rows, points, k, block_rows, query_block_rows)


def knn_join_voronoi(
    queries: DataFrame, corpus: DataFrame, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
    query_block_rows: int = QUERY_BLOCK_ROWS, lanes: int = MERGE_LANES,
) -> DataFrame:
    """The k nearest corpus rows (id, vector) of every query (query_id, vector) by squared distance, exactly.

    Returns (query_id, vector_rank, id, distance); distances are rounded to six
    digits and ties go to the smaller id, as in ``knn_join``.  Neither side
    need fit anywhere; rows without a vector are left out.  Blocks have at
    least ``block_rows`` and ``query_block_rows`` rows of a cell, if it has so many.
    """
    asked, rows, cells = _prepared(queries, corpus, k, pivots, block_rows, query_block_rows)
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("_key", T.DoubleType()),
    ])
    if cells is None:
        return queries.sparkSession.createDataFrame([], schema).select(
            "query_id", F.lit(1).alias("vector_rank"), "id", F.col("_key").alias("distance")
        )
    left, right = _meetings(asked, rows, cells, k)
    id_type = _arrow_type(schema["id"].dataType)

    def meet(left_block: pa.Table, right_block: pa.Table) -> pa.Table:
        best = _Best(_load_queries(right_block, 0), k, "l2sq", id_type)
        for batch in left_block.to_batches(max_chunksize=8_192):
            best.add(batch.column("id").cast(id_type), _matrix(batch.column("vector")), None)
        return pa.Table.from_batches([best.batch()])

    found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(meet, schema)
    ranked = first_n(found, k, ["query_id"], [F.col("_key").asc(), F.col("id").asc()], "vector_rank", lanes)
    return ranked.select("query_id", "vector_rank", "id", F.col("_key").alias("distance"))


def join_costs(
    queries: DataFrame, corpus: DataFrame, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
    query_block_rows: int = QUERY_BLOCK_ROWS,
) -> DataFrame:
    """(plan, rows_shuffled, pairs_scored) of this plan, and of one in which every block meets every block."""
    asked, rows, cells = _prepared(queries, corpus, k, pivots, block_rows, query_block_rows)
    if cells is None:
        raise ValueError("there is nothing to search")
    left, right = _meetings(asked, rows, cells, k)
    corpus_side = left.groupBy("_c", "_q").agg(F.count("*").alias("corpus_rows"))
    query_side = right.groupBy("_c", "_q").agg(F.count("*").alias("query_rows"))
    both = corpus_side.join(query_side, ["_c", "_q"], "full").na.fill(0)
    own = both.agg(
        F.lit("voronoi").alias("plan"), F.sum(F.col("corpus_rows") + F.col("query_rows")).alias("rows_shuffled"),
        F.sum(F.col("corpus_rows") * F.col("query_rows")).alias("pairs_scored"),
    )
    counts = asked.agg(F.count("*").alias("q")).crossJoin(rows.agg(F.count("*").alias("c")))  # two single rows
    grid = counts.select(
        F.lit("grid").alias("plan"),
        (F.col("c") * F.ceil(F.col("q") / query_block_rows) + F.col("q") * F.ceil(F.col("c") / block_rows)).alias("rows_shuffled"),
        (F.col("q") * F.col("c")).alias("pairs_scored"),
    )
    return own.unionByName(grid)
