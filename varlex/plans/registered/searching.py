"""Search, rerank, query understanding and context operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions import text as X
from varlex.operators import context, knn
from varlex.operators.annotate import annotate_queries as annotate
from varlex.operators.rerank import keep_best
from varlex.operators.rerank import rerank as rerank_candidates
from varlex.plans import search as S
from varlex.plans.registered import roles as R

K = 10
CELLS = 16


def _ranks(df: DataFrame) -> DataFrame:
    names = [c for c in ("vector_rank", "final_rank", "rank") if c in df.columns]
    return R.longs(df, *names)


# -- similarity and nearest neighbours ---------------------------------------
def dot_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its successor."""
    embeddings = R.table(spark, sf_dir, "embeddings")
    left = embeddings.select("vec_id", F.col("embedding").alias("left"))
    right = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right"))
    scored = knn.pair_scores(left.join(right, "vec_id"), "dot")
    return scored.select(F.col("vec_id").alias("id"), F.col("score"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(dot_similarity(spark, sf_dir), fixed.CLI_TOP_K)


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(knn.knn_join(R.vector_queries(spark, sf_dir), R.vectors(spark, sf_dir), K))


def knn_join_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(
        knn.knn_join(R.vector_queries(spark, sf_dir), R.vectors(spark, sf_dir), fixed.CLI_TOP_K, "dot")
    )


def knn_join_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for query tables too large to broadcast."""
    return _ranks(
        knn.knn_join(
            R.vector_queries(spark, sf_dir), R.vectors(spark, sf_dir), K,
            max_broadcast_queries=0, block_rows=256, query_block_rows=256,
        )
    )


def approx_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell probed: equal to the exact search."""
    return _approx(spark, sf_dir, CELLS)


def approx_knn_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the cells probed."""
    return _approx(spark, sf_dir, CELLS // 4)


def _approx(spark: SparkSession, sf_dir: str, nprobe: int) -> DataFrame:
    corpus = R.vectors(spark, sf_dir)
    model = knn.fit_cells(corpus, CELLS)
    cells = knn.assign_cells(corpus, model)
    return _ranks(knn.approx_knn(R.vector_queries(spark, sf_dir), cells, model, K, nprobe))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = R.vector_queries(spark, sf_dir).withColumn("sources", S.source_filter("sources", 10))
    return _ranks(
        knn.knn_join(queries, R.vectors(spark, sf_dir), K, where={"source": "sources"}, payload=["source"])
    )


def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir)


def distance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distance_threshold(_filtered(spark, sf_dir), fixed.DEFAULT_MAX_DISTANCE)


def similarity_from_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _filtered(spark, sf_dir)
    return found.select("query_id", "id", F.round(knn.similarity(), 6).alias("vector_score"))


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the filtered search ranked by similarity rounded to tenths."""
    scored = _filtered(spark, sf_dir).withColumn("vector_score", F.round(knn.similarity(), 1))
    return _ranks(knn.rank_candidates(scored)).select("query_id", "id", "vector_score", "rank")


def resolve_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resolve_metadata(R.store(spark, sf_dir)).select(
        "id", "source_dataset", "table_id", "variable_id", "variable_name"
    )


# -- rerank and search --------------------------------------------------------
def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = S.resolve_metadata(R.store(spark, sf_dir)).withColumn(
        "description", F.when(F.col("indicator_id").isNotNull(), F.col("document"))
    )
    return candidates.select("id", X.pair_text().alias("pair"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = knn.knn_join(
        R.search_queries(spark, sf_dir), R.store(spark, sf_dir), fixed.OVERFETCH * fixed.DEFAULT_RESULTS,
        payload=["metadata", "document"], carry=["query"],
    )
    return S.resolve_metadata(nearest.withColumnRenamed("document", "description"))


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rerank_candidates(_candidates(spark, sf_dir))
    return _ranks(ranked).select("query_id", "id", "vector_rank", "rerank_score", "final_rank")


def overfetch_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = keep_best(rerank_candidates(_candidates(spark, sf_dir)), fixed.DEFAULT_RESULTS)
    return _ranks(ranked).select("query_id", "id", "final_rank")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(R.search_queries(spark, sf_dir), R.store(spark, sf_dir))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ranks(_matches(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("vector_score", "distance")}
    return found.withColumns(rounded).drop("query")


# -- query understanding ------------------------------------------------------
def _query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )


def demographic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all texts that read like queries or statements."""
    documents = R.even(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("query_id"), F.col("text").alias("query")
    )
    return _query_log(spark, sf_dir).unionByName(documents).select(
        "query_id", F.array_join(X.demographic_tags("query"), ",").alias("tags")
    )


def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_log(spark, sf_dir).select(
        "query_id", F.array_join(X.extract_keywords("query"), " ").alias("keywords")
    )


def annotate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = annotate(_query_log(spark, sf_dir))
    return parsed.select(
        "query_id",
        "original_query",
        F.array_join("extracted_keywords", " ").alias("keywords"),
        F.size("named_entities").cast("bigint").alias("n_entities"),
        F.array_join("inferred_demographics", ",").alias("tags"),
    )


# -- exports and context -------------------------------------------------------
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(context.export_records(_matches(spark, sf_dir)))


def target_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = context.target_ids(_matches(spark, sf_dir), queries=R.search_queries(spark, sf_dir))
    return ids.select("query_id", F.array_join("target_ids", ",").alias("target_ids"))


def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_block(_matches(spark, sf_dir), queries=R.search_queries(spark, sf_dir))


def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = R.search_queries(spark, sf_dir).select("query_id", "query")
    return context.build_prompt(queries, context.context_block(_matches(spark, sf_dir)))


QUERIES = {
    fn.__name__: fn
    for fn in (
        dot_similarity, top_k, knn_join, knn_join_dot, knn_join_blocks, approx_knn, approx_knn_probed,
        source_filter, distance_threshold, similarity_from_distance, rank_candidates, resolve_metadata, pair_text, rerank,
        overfetch_truncate, search, demographic_tags, extract_keywords, annotate_queries,
        export_records, target_ids, context_block, build_prompt,
    )
}

_DISTANCE = "round(pow(list_distance(q.vector, v.vector), 2), 6)"


def _nearest(k: int, condition: str = "TRUE") -> str:
    return R.ctes("vectors", "vector_queries") + f""",
    scored AS (
        SELECT q.query_id, v.id, v.source, {_DISTANCE} + 0.0 AS distance
        FROM vector_queries q CROSS JOIN vectors v WHERE {condition}),
    nearest AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vector_rank FROM scored
        QUALIFY vector_rank <= {k})"""


_FILTERED = _nearest(K, "q.sources IS NULL OR list_contains(q.sources, v.source)")

_DOT = """
    WITH pairs AS (
        SELECT a.vec_id AS id,
               round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _words(expression: str) -> str:
    return (
        f"list_distinct(list_filter(string_split_regex(lower({expression}), '[^\\p{{L}}\\p{{N}}]+'),"
        " lambda w: w <> ''))"
    )


_PAIR = "r_source || ' | ' || r_name || ' | ' || document"


def _overlap(query: str, pair: str) -> str:
    wanted = _words(query)
    return (
        f"CASE WHEN len({wanted}) > 0 THEN round(len(list_intersect({wanted}, {_words(pair)}))"
        f"::DOUBLE / len({wanted}), 6) ELSE 0.0 END"
    )


_CANDIDATES = R.ctes("store", "search_queries") + f""",
    scored AS (
        SELECT q.query_id, q.query, v.*, {_DISTANCE} AS distance
        FROM search_queries q CROSS JOIN store v),
    nearest AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vector_rank FROM scored
        QUALIFY vector_rank <= 10),
    reranked AS (SELECT *, {_overlap("query", _PAIR)} AS rerank_score FROM nearest),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank) AS final_rank
        FROM reranked)"""

_SEARCH = R.ctes("store", "search_queries") + f""",
    scored AS (
        SELECT q.query_id, q.query, q.n, q.max_dist, v.*, {_DISTANCE} AS distance
        FROM search_queries q CROSS JOIN store v
        WHERE q.sources IS NULL OR list_contains(q.sources, v.source)),
    nearest AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vector_rank FROM scored
        QUALIFY vector_rank <= 2 * n),
    near AS (SELECT * FROM nearest WHERE distance <= max_dist),
    reranked AS (SELECT *, {_overlap("query", _PAIR)} AS rerank_score FROM near),
    found AS (
        SELECT query_id, query, id, vector_rank, distance, round(1 - distance, 6) AS vector_score, rerank_score,
               r_source AS source_dataset, r_table AS table_id, coalesce(indicator_id, r_variable) AS variable_id,
               r_name AS variable_name, document AS description, n,
               row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank) AS final_rank
        FROM reranked QUALIFY final_rank <= n),
    context AS (
        SELECT query_id, string_agg('[Match #' || final_rank || ' | Source: ' || source_dataset || ' | Code: '
            || variable_id || ']' || chr(10) || description, chr(10) || chr(10) ORDER BY final_rank) AS context
        FROM found GROUP BY query_id)"""

_LOG = """
    WITH log AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations)"""


def _any(words) -> str:
    return " OR ".join(f"contains(lower(query), '{w}')" for w in words)


_TAGS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {_any(words)} THEN '{label}' END" for label, words in fixed.DEMOGRAPHICS
) + ")"
_STOPS = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"
_KEYWORDS = (
    f"array_to_string(list_sort(list_filter({_words('query')}, lambda w: NOT list_contains({_STOPS}, w))), ' ')"
)

SQL = {
    "dot_similarity": _DOT + " SELECT id, score FROM pairs",
    "top_k": _DOT + f" SELECT id, score FROM pairs ORDER BY score DESC, id LIMIT {fixed.CLI_TOP_K}",
    "knn_join": _nearest(K) + " SELECT query_id, vector_rank, id, distance FROM nearest",
    "knn_join_blocks": _nearest(K) + " SELECT query_id, vector_rank, id, distance FROM nearest",
    "approx_knn": _nearest(K) + " SELECT query_id, vector_rank, id, distance FROM nearest",
    "knn_join_dot": R.ctes("vectors", "vector_queries") + f"""
        SELECT q.query_id, v.id, round(list_inner_product(q.vector, v.vector), 6) AS score,
               row_number() OVER (PARTITION BY q.query_id
                   ORDER BY round(list_inner_product(q.vector, v.vector), 6) DESC, v.id) AS vector_rank
        FROM vector_queries q CROSS JOIN vectors v QUALIFY vector_rank <= {fixed.CLI_TOP_K}""",
    "source_filter": _FILTERED + " SELECT query_id, vector_rank, id, distance, source FROM nearest",
    "distance_threshold": _FILTERED + """
        SELECT query_id, vector_rank, id, distance, source FROM nearest WHERE distance <= 1.5""",
    "similarity_from_distance": _FILTERED + """
        SELECT query_id, id, round(1 - distance, 6) AS vector_score FROM nearest""",
    "rank_candidates": _FILTERED + """
        SELECT query_id, id, round(1 - distance, 1) AS vector_score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(1 - distance, 1) DESC, vector_rank) AS rank
        FROM nearest""",
    "resolve_metadata": R.ctes("store") + """
        SELECT id, r_source AS source_dataset, r_table AS table_id, r_variable AS variable_id,
               r_name AS variable_name FROM store""",
    "pair_text": R.ctes("store") + """
        SELECT id, r_source || ' | ' || r_name || ' | '
               || CASE WHEN indicator_id IS NOT NULL THEN document ELSE '' END AS pair
        FROM store""",
    "rerank": _CANDIDATES + " SELECT query_id, id, vector_rank, rerank_score, final_rank FROM ranked",
    "overfetch_truncate": _CANDIDATES + """
        SELECT query_id, id, final_rank FROM ranked WHERE final_rank <= 5""",
    "search": _SEARCH + """
        SELECT query_id, id, final_rank, rerank_score, vector_rank, vector_score,
               distance, source_dataset, table_id, variable_id, variable_name, description
        FROM found""",
    "demographic_tags": _LOG + f"""
        SELECT query_id, {_TAGS} AS tags
        FROM (SELECT * FROM log UNION ALL SELECT -doc_id - 1, text FROM documents)""",
    "extract_keywords": _LOG + f" SELECT query_id, {_KEYWORDS} AS keywords FROM log",
    "annotate_queries": _LOG + f"""
        SELECT query_id, query AS original_query, {_KEYWORDS} AS keywords, CAST(0 AS BIGINT) AS n_entities,
               {_TAGS} AS tags FROM log""",
    "export_records": _SEARCH + """
        SELECT query_id, final_rank, source_dataset, table_id, variable_id, description FROM found""",
    "target_ids": _SEARCH + """
        SELECT q.query_id, coalesce(string_agg(f.variable_id, ',' ORDER BY f.final_rank), '') AS target_ids
        FROM search_queries q LEFT JOIN found f ON f.query_id = q.query_id AND f.variable_id <> ''
        GROUP BY q.query_id""",
    "context_block": _SEARCH + """
        SELECT q.query_id, coalesce(c.context, '') AS context
        FROM search_queries q LEFT JOIN context c ON c.query_id = q.query_id""",
    "build_prompt": _SEARCH + f"""
        SELECT q.query_id, '{fixed.SYSTEM_PROMPT.format(registers="registers").replace("'", "''")}' AS system_prompt,
               'Context Blocks:' || chr(10) || coalesce(c.context, '') || chr(10) || chr(10)
                   || 'User Question: ' || q.query AS user_prompt
        FROM search_queries q LEFT JOIN context c ON c.query_id = q.query_id""",
}
