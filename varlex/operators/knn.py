"""Nearest neighbours of a table of queries in a table of vectors.

Two exact physical plans share one kernel:

* few queries (a checked size): the query matrix is broadcast, the corpus never
  moves, each partition keeps its own best k per query;
* many queries: both sides are hashed into even blocks, every query block meets
  every corpus block once, and each meeting again keeps only its best k.  Blocks
  are as large as memory and the number of cores allow, since a row is sent
  once for each block of the other side.

Either way at most k rows per query leave a task; pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlex.functions.vectors import dot, l2sq
from varlex.operators.ordering import first_n

SCORE_DIGITS = 6
# Ceiling of the broadcast plan; beyond either the block plan takes over.
MAX_BROADCAST_QUERIES = 8_192
MAX_BROADCAST_BYTES = 128 << 20
# Rows per block of the block plan: about 100 MB of 384-d float32 vectors.
BLOCK_ROWS = 65_536
QUERY_BLOCK_ROWS = 16_384
# Meetings of two blocks for each core; with more of them than that blocks grow.
MEETINGS_PER_CORE = 6
# Scores held at once by the kernel (8 MB of doubles).
SCORES_AT_ONCE = 1 << 20
# Candidates that wait to be merged, at least.
MERGE_ROWS = 65_536


@dataclass
class _Queries:
    """Query vectors and, per filtered corpus column, who accepts which value."""

    ids: pa.Array
    matrix: np.ndarray
    accepts: list[dict] = field(default_factory=list)
    unfiltered: list[np.ndarray] = field(default_factory=list)

    def mask(self, column: int, value) -> np.ndarray:
        table = self.accepts[column]
        return table.get(value, self.unfiltered[column]) if value is not None else self.unfiltered[column]


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.empty((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _load_queries(table: pa.Table, filters: int) -> _Queries:
    """Arrow table of (query_id, vector, allowed_0, allowed_1, ...)."""
    queries = _Queries(
        table.column("query_id").combine_chunks(), _matrix(table.column("vector")).astype(np.float64)
    )
    for i in range(filters):
        lists = table.column(f"allowed_{i}").to_pylist()
        free = np.array([values is None for values in lists], dtype=bool)
        accepts: dict = {}
        for q, values in enumerate(lists):
            for value in values or ():
                if value is None:
                    continue
                if value not in accepts:
                    accepts[value] = free.copy()
                accepts[value][q] = True
        queries.accepts.append(accepts)
        queries.unfiltered.append(free)
    return queries


class _Best:
    """Running best k per query; ties are settled by the smaller id."""

    def __init__(self, queries: _Queries, k: int, metric: str, id_type: pa.DataType):
        self.queries, self.k, self.metric = queries, k, metric
        self.bound = np.full(len(queries.ids), np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.key = np.empty(0)
        self.id = pa.array([], type=id_type)
        self.last = pa.nulls(len(queries.ids), id_type)
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.right = -queries.matrix
        if metric == "l2sq" and len(queries.ids):
            # x.x - 2 x.y + y.y as one product of (x, x.x, 1) and (-2 y, 1, y.y).
            length = (queries.matrix**2).sum(axis=1)
            self.right = np.column_stack([2.0 * self.right, np.ones(len(length)), length])

    def add(self, ids: pa.Array, vectors: np.ndarray, accepted: np.ndarray | None) -> None:
        chosen = np.arange(len(self.bound)) if accepted is None else np.flatnonzero(accepted)
        if not len(chosen) or not len(ids):
            return
        right = self.right if len(chosen) == len(self.bound) else self.right[chosen]
        step = max(1, SCORES_AT_ONCE // len(chosen))
        for start in range(0, len(ids), step):
            self._add_block(ids.slice(start, step), vectors[start : start + step], chosen, right)

    def _add_block(self, ids: pa.Array, vectors: np.ndarray, chosen: np.ndarray, right: np.ndarray) -> None:
        block = vectors.astype(np.float64)
        if self.metric == "l2sq":
            block = np.column_stack([block, (block**2).sum(axis=1), np.ones(len(block))])
        keys = block @ right.T
        # Half a unit in the last kept digit may still round to the bound.
        bound = self.bound[chosen]
        if len(ids) > self.k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(keys, self.k - 1, axis=0)[self.k - 1])
        rows, columns = np.nonzero(keys <= bound[None, :] + 10.0**-SCORE_DIGITS)
        if not len(rows):
            return
        found = keys[rows, columns]
        if self.metric == "l2sq":
            np.maximum(found, 0.0, out=found)
        found = np.round(found, SCORE_DIGITS) + 0.0
        who = chosen[columns]
        names = ids.take(pa.array(rows))
        worst = self.bound[who]
        earlier = pc.less(names, self.last.take(pa.array(who))).fill_null(True)
        keep = (found < worst) | ((found == worst) & earlier.to_numpy(zero_copy_only=False))
        if keep.any():
            self.waiting.append((who[keep], found[keep], names.filter(pa.array(keep))))
            # Bounds may be old for a while, as a merge sorts all that is kept.
            if sum(len(q) for q, _, _ in self.waiting) >= max(len(self.q), MERGE_ROWS):
                self._merge()

    def _merge(self) -> None:
        if not self.waiting:
            return
        q = np.concatenate([self.q, *(w[0] for w in self.waiting)])
        key = np.concatenate([self.key, *(w[1] for w in self.waiting)])
        name = pa.concat_arrays([self.id, *(w[2] for w in self.waiting)])
        self.waiting = []
        order = pc.sort_indices(
            pa.table({"q": q, "key": key, "id": name}),
            sort_keys=[("q", "ascending"), ("key", "ascending"), ("id", "ascending")],
        ).to_numpy()
        sorted_q = q[order]
        first = np.r_[True, sorted_q[1:] != sorted_q[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank = np.arange(len(order)) - start
        kept = order[rank < self.k]
        self.q, self.key, self.id = q[kept], key[kept], name.take(pa.array(kept))
        full = order[rank == self.k - 1]
        if len(full):
            self.bound[q[full]] = key[full]
            last = np.full(len(self.bound), -1)
            last[q[full]] = full
            self.last = name.take(pa.array(last, mask=last < 0))

    def batch(self) -> pa.RecordBatch:
        self._merge()
        return pa.RecordBatch.from_arrays(
            [self.queries.ids.take(pa.array(self.q)), self.id, pa.array(self.key)],
            ["query_id", "id", "_key"],
        )


def _feed(best: _Best, ids: pa.Array, vectors: pa.Array, columns: list[pa.Array]) -> None:
    """Add a batch, one sub-block per combination of filtered column values."""
    matrix = _matrix(vectors)
    if not columns:
        best.add(ids, matrix, None)
        return
    coded = [c.dictionary_encode() for c in columns]
    codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
    values = [c.dictionary.to_pylist() for c in coded]
    combined = np.zeros(len(ids), dtype=np.int64)
    for code, value in zip(codes, values):
        combined = combined * (len(value) + 1) + code + 1
    for combination in np.unique(combined):
        rows = np.flatnonzero(combined == combination)
        accepted = np.ones(len(best.bound), dtype=bool)
        for i, code in enumerate(codes):
            at = code[rows[0]]
            accepted &= best.queries.mask(i, values[i][at] if at >= 0 else None)
        if accepted.any():
            best.add(ids.take(pa.array(rows)), matrix[rows], accepted)


def _result_schema(queries: DataFrame, corpus: DataFrame, id_column: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType, True),
            T.StructField("id", corpus.schema[id_column].dataType, True),
            T.StructField("_key", T.DoubleType(), True),
        ]
    )


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "l2sq",
    where: Mapping[str, str] | None = None,
    payload: Sequence[str] = (),
    carry: Sequence[str] = (),
    id_column: str = "id",
    vector_column: str = "vector",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
    query_block_rows: int = QUERY_BLOCK_ROWS,
    lanes: int | None = None,
    scan_tasks: int | None = None,
) -> DataFrame:
    """The k nearest corpus rows of every query, exactly.

    ``queries`` has ``query_id`` and ``vector``; ``where`` maps a corpus column
    to the query column with its allowed values (an array; null means no
    filter).  The filter acts before the top k is taken.  Returns ``query_id,
    vector_rank, id, distance`` for ``l2sq`` or ``..., score`` for ``dot``;
    values are rounded to six digits before ranking so that the order does not
    depend on how rows were partitioned, and ties go to the smaller id.
    Only ids, vectors and filter columns are scanned for the search; ``payload``
    names corpus columns to join back for the winners, ``carry`` query columns
    to keep.  Blocks of the plan for many queries have at least ``block_rows``
    and ``query_block_rows`` rows.  ``scan_tasks`` merges scan splits into that many tasks, without a shuffle,
    so that a corpus of very many splits writes fewer local candidates.
    """
    if metric not in ("l2sq", "dot"):
        raise ValueError(f"metric must be l2sq or dot, not {metric!r}")
    where = dict(where or {})
    asked = queries.where(F.col("vector").isNotNull()).select(
        "query_id", "vector",
        *[F.col(c).alias(f"allowed_{i}") for i, c in enumerate(where.values())], *carry,
    )
    rows = corpus.select(
        F.col(id_column).alias("id"),
        F.col(vector_column).alias("vector"),
        *[F.col(c).alias(f"value_{i}") for i, c in enumerate(where)],
    )
    schema = _result_schema(queries, corpus, id_column)
    # At most max_broadcast_queries + 1 rows ever reach the driver here.
    head = asked.limit(max_broadcast_queries + 1).toArrow()
    few = head.num_rows <= max_broadcast_queries and head.nbytes <= MAX_BROADCAST_BYTES
    if few:
        rows = rows.coalesce(scan_tasks) if scan_tasks else rows
        best = _broadcast_plan(head, rows, k, metric, len(where), schema)
    else:
        rows = rows.where(F.col("vector").isNotNull())
        best = _block_plan(asked.drop(*carry), rows, k, metric, len(where), schema, block_rows, query_block_rows)
    ranked = first_n(
        best, k, ["query_id"], [F.col("_key").asc(), F.col("id").asc()], "vector_rank", lanes
    )
    value = F.col("_key").alias("distance") if metric == "l2sq" else (-F.col("_key") + 0.0).alias("score")
    winners = ranked.select("query_id", "vector_rank", "id", value)
    if carry:
        kept = asked.select("query_id", *carry)
        winners = winners.join(F.broadcast(kept) if few else kept, "query_id")
    if not payload:
        return winners
    carried = corpus.select(F.col(id_column).alias("id"), *payload)
    # At most k rows for each of the counted queries, so the winners go to the
    # corpus; with uncounted queries Spark chooses the join.
    return carried.join(F.broadcast(winners) if few else winners, "id")


def _broadcast_plan(
    head: pa.Table, rows: DataFrame, k: int, metric: str, filters: int, schema: T.StructType
) -> DataFrame:
    queries = _load_queries(head, filters)
    # Plain arrays only: broadcast values are pickled without the package's code.
    shared = rows.sparkSession.sparkContext.broadcast(
        (queries.ids, queries.matrix, queries.accepts, queries.unfiltered)
    )
    id_type = _arrow_type(schema["id"].dataType)
    # If no query is free of a filter, only accepted values need be scanned.
    for i in range(filters):
        if not queries.unfiltered[i].any() and len(queries.accepts[i]) <= 1_000:
            rows = rows.where(F.col(f"value_{i}").isin(list(queries.accepts[i])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(_Queries(*shared.value), k, metric, id_type)
        for batch in batches:
            # Not before: Spark would push the filter down and draw computed vectors a second time for it.
            if batch.column(1).null_count:
                batch = batch.filter(batch.column(1).is_valid())
            columns = [batch.column(2 + i) for i in range(filters)]
            _feed(best, batch.column(0).cast(id_type), batch.column(1), columns)
        yield best.batch()

    return rows.mapInArrow(scan, schema)


def block_sizes(
    rows: Sequence[int], queries: Sequence[int], block_rows: int, query_block_rows: int, cores: int
) -> tuple[int, int]:
    """Rows of a corpus block and of a query block for groups of these sizes.

    At least the rows asked for; blocks are doubled, up to the module's limits,
    while there are more meetings than keep all cores busy.  So the number of
    times that a row is sent doesn't grow with the table before blocks are full.
    """

    def blocks(groups: Sequence[int], size: int) -> int:
        return sum(-(-int(n) // size) for n in groups)

    while blocks(rows, block_rows) * blocks(queries, query_block_rows) > MEETINGS_PER_CORE * cores:
        corpus, asked = block_rows < BLOCK_ROWS, query_block_rows < QUERY_BLOCK_ROWS
        if corpus and (block_rows <= query_block_rows or not asked):
            block_rows = min(2 * block_rows, BLOCK_ROWS)
        elif asked:
            query_block_rows = min(2 * query_block_rows, QUERY_BLOCK_ROWS)
        else:
            break
    return block_rows, query_block_rows


def _block_plan(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    metric: str,
    filters: int,
    schema: T.StructType,
    block_rows: int,
    query_block_rows: int,
) -> DataFrame:
    """Even hash blocks of both sides; every pair of blocks meets once.

    Block numbers come from a row hash, so a value shared by a third of the
    rows does not make a block larger.
    """
    n_rows, n_queries = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block_rows, query_block_rows = block_sizes([n_rows], [n_queries], block_rows, query_block_rows, cores)
    corpus_blocks = max(1, -(-n_rows // block_rows))
    query_blocks = max(1, -(-n_queries // query_block_rows))
    id_type = _arrow_type(schema["id"].dataType)

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(corpus_blocks)).cast("int")).withColumn(
        "_q", numbers(query_blocks)
    )
    right = queries.withColumn(
        "_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    ).withColumn("_c", numbers(corpus_blocks))

    def meet(left_block: pa.Table, right_block: pa.Table) -> pa.Table:
        best = _Best(_load_queries(right_block, filters), k, metric, id_type)
        for batch in left_block.to_batches(max_chunksize=8_192):
            columns = [batch.column(f"value_{i}") for i in range(filters)]
            _feed(best, batch.column("id").cast(id_type), batch.column("vector"), columns)
        return pa.Table.from_batches([best.batch()])

    return left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(meet, schema)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    known = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
    if data_type not in known:
        raise TypeError(f"ids must be string, long or int, not {data_type}")
    return known[data_type]


def similarity(distance: Column | str = "distance") -> Column:
    """``1 - distance``; with squared distances this is not a cosine."""
    return F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance)


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """Best k rows overall, descending, with a stable order."""
    return scored.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)


def rank_candidates(
    df: DataFrame, score: str = "vector_score", tie: str = "vector_rank", name: str = "rank"
) -> DataFrame:
    """Position of every candidate in its query, best score first."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(order))


def pair_scores(pairs: DataFrame, metric: str = "l2sq") -> DataFrame:
    """Built-in scoring of already paired vectors, the cross-check of the kernel."""
    value = l2sq("left", "right") if metric == "l2sq" else dot("left", "right")
    return pairs.withColumn("distance" if metric == "l2sq" else "score", F.round(value, SCORE_DIGITS))


def fit_cells(corpus: DataFrame, cells: int, seed: int = 7, vector: str = "vector") -> KMeansModel:
    """Cluster centres for the approximate index."""
    features = corpus.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=20).fit(features)


def assign_cells(corpus: DataFrame, model: KMeansModel, vector: str = "vector") -> DataFrame:
    """Corpus rows with the number of their nearest centre in ``cell``."""
    with_features = corpus.withColumn(
        "features", array_to_vector(F.col(vector).cast("array<double>"))
    )
    return model.setPredictionCol("cell").transform(with_features).drop("features")


def probe_cells(queries: DataFrame, model: KMeansModel, nprobe: int) -> DataFrame:
    """Queries with the numbers of their ``nprobe`` nearest centres."""
    centres = np.array(model.clusterCenters())
    nprobe = min(nprobe, len(centres))

    def nearest(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors).astype(np.float64)
        gaps = (centres**2).sum(axis=1)[None, :] - 2.0 * matrix @ centres.T
        order = np.argsort(gaps, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
        offsets = np.arange(len(vectors) + 1, dtype=np.int32) * nprobe
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.reshape(-1)))

    return queries.where(F.col("vector").isNotNull()).withColumn(
        "cells", F.arrow_udf(nearest, "array<int>")("vector")
    )


def approx_knn(
    queries: DataFrame,
    cells: DataFrame,
    model: KMeansModel,
    k: int,
    nprobe: int,
    metric: str = "l2sq",
    where: Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """k nearest rows among the cells nearest to each query.

    ``cells`` is a corpus from ``assign_cells``, best stored partitioned by
    ``cell``.  Rows are only compared with queries that probe their cell, where
    they lie; nothing is shuffled by cell, so a large cell is no hot spot.
    ``nprobe`` equal to the number of centres gives the exact answer.
    """
    probing = probe_cells(queries, model, nprobe)
    return knn_join(probing, cells, k, metric, {**(where or {}), "cell": "cells"}, **options)
