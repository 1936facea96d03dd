"""Indexes on the given tables: cells of vectors, large joins, postings and a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.operators import cell_index, gazetteer, postings, voronoi
from varlex.plans.registered import roles as R
from varlex.plans.registered.searching import _CANDIDATES, _LOG, K, _candidates, _nearest, _ranks
from varlex.session import fresh_path

NPROBE = 3
PROBES = (1, 3, 10)


# -- cells of vectors ---------------------------------------------------------
def _label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label as the centre of a cell."""
    spread = R.table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "value")
    )
    means = spread.groupBy("label", "at").agg(F.avg("value").alias("value"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
    return listed.select(F.col("label").cast("int").alias("cell"), F.col("all.value").alias("centre"))


def _index(spark: SparkSession, sf_dir: str, coded: bool) -> str:
    """An index of all embeddings, every other one added after the first."""
    path = fresh_path(spark, "cells")
    rows = R.vectors(spark, sf_dir)
    odd = F.col("id") % 2 == 1
    cell_index.write_index(spark, rows.where(~odd), path, _label_centres(spark, sf_dir), coded=coded)
    cell_index.add_rows(spark, rows.where(odd), path)
    return path


def cell_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against the rows of their three nearest cells."""
    path = _index(spark, sf_dir, False)
    return _ranks(cell_index.search_cells(spark, path, R.vector_queries(spark, sf_dir), K, NPROBE))


def cell_index_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by codes; rows whose codes are far are not compared, so this one is approximate in its cells too."""
    path = _index(spark, sf_dir, True)
    return _ranks(cell_index.search_codes(spark, path, R.vector_queries(spark, sf_dir), K, NPROBE))


def cell_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read and exact neighbours found with one, three and all cells probed."""
    path = _index(spark, sf_dir, False)
    return cell_index.recall_by_cells(spark, path, R.vector_queries(spark, sf_dir), K, PROBES)


# -- large by large ----------------------------------------------------------
def knn_join_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against all embeddings over pivots' cells, in blocks."""
    return _ranks(voronoi.knn_join_voronoi(
        R.vector_queries(spark, sf_dir), R.vectors(spark, sf_dir), K, pivots=16, block_rows=512, query_block_rows=512
    ))


# -- names in texts ------------------------------------------------------------
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All part names, and as names the first one, two or three words of every document."""
    parts = R.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.lit("PART").alias("label"), F.col("p_brand").alias("meaning")
    )
    words = gazetteer.word_sequence("text")
    starts = R.table(spark, sf_dir, "documents").select(
        F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("name"),
        F.upper("lang").alias("label"), F.col("source").alias("meaning"),
    )
    return parts.unionByName(starts)


def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every conversation turn."""
    log = R.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("query_id"), F.col("text").alias("query")
    )
    linked = gazetteer.annotate_with_names(log, names(spark, sf_dir))
    each = F.transform("named_entities", lambda e: F.concat_ws("|", e["text"], e["label"], e["meaning"]))
    return linked.select("query_id", F.size("named_entities").cast("bigint").alias("n_entities"), F.array_join(each, ";").alias("entities"))


# -- postings ------------------------------------------------------------------
def _postings(spark: SparkSession, sf_dir: str) -> str:
    """All store documents, of which every other one replaces another text of an earlier batch."""
    path = fresh_path(spark, "postings")
    docs = R.store(spark, sf_dir).select("id", "document")
    early = docs.where(F.xxhash64("id") % 2 == 0).select("id", F.concat_ws(" ", F.lit("earlier text of"), "id").alias("document"))
    postings.add_documents(spark, early, path, buckets=8)
    postings.add_documents(spark, docs, path, buckets=8)
    return path


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_statistics(spark, _postings(spark, sf_dir))


def bm25_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest documents of every benchmark text, reranked by BM25."""
    staged = fresh_path(spark, "candidates")
    _candidates(spark, sf_dir).select("query_id", "query", "id", "vector_rank").write.parquet(staged)
    ranked = postings.bm25_rerank(spark, spark.read.parquet(staged), _postings(spark, sf_dir), buckets=8)
    return _ranks(ranked).select("query_id", "id", "vector_rank", "rerank_score", "final_rank")


QUERIES = {
    fn.__name__: fn
    for fn in (
        cell_index_search, cell_index_codes, cell_index_recall, knn_join_voronoi, link_entities, term_statistics, bm25_rerank,
    )
}

_GAP = "round(pow(list_distance(x.vector, c.centre), 2), 6)"
_CELLS = R.ctes("vectors", "vector_queries") + f""",
    spread AS (
        SELECT label, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS value FROM embeddings),
    means AS (SELECT label, pos, avg(value) AS value FROM spread GROUP BY label, pos),
    centres AS (SELECT label AS cell, list(value ORDER BY pos) AS centre FROM means GROUP BY label),
    placed AS (
        SELECT x.id, x.vector, c.cell FROM vectors x CROSS JOIN centres c
        QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {_GAP}, c.cell) = 1),
    probes AS (
        SELECT x.query_id, x.vector, c.cell, row_number() OVER (PARTITION BY x.query_id ORDER BY {_GAP}, c.cell) AS probe
        FROM vector_queries x CROSS JOIN centres c),
    scored AS (
        SELECT p.query_id, v.id, p.probe, round(pow(list_distance(p.vector, v.vector), 2), 6) + 0.0 AS distance
        FROM probes p JOIN placed v ON v.cell = p.cell)"""

_RECALL = " UNION ALL ".join(f"""
    SELECT CAST({n} AS BIGINT) AS nprobe,
           (SELECT count(*) FROM scored WHERE probe <= {n}) AS rows_read, (SELECT count(*) FROM scored) AS rows_all,
           (SELECT count(*) FROM best JOIN best_{n} USING (query_id, id)) AS found, (SELECT count(*) FROM best) AS wanted"""
    for n in PROBES)
_BEST = ", ".join(f"""
    best_{n} AS (
        SELECT query_id, id FROM scored WHERE probe <= {n}
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K})""" for n in PROBES)

_SEQUENCE = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

_ENTITIES = _LOG.replace("WITH log", "WITH RECURSIVE log") + f""",
    named AS (
        SELECT {_SEQUENCE.format("p_name")} AS words, 'PART' AS label, p_brand AS meaning FROM part
        UNION ALL
        SELECT {_SEQUENCE.format("text")}[1:doc_id % 3 + 1], upper(lang), source FROM documents),
    gazetteer AS (
        SELECT array_to_string(words, ' ') AS spelled, len(words) AS n, label, meaning FROM named WHERE len(words) > 0
        QUALIFY row_number() OVER (PARTITION BY words ORDER BY label NULLS FIRST, meaning NULLS FIRST) = 1),
    texts AS (SELECT query_id, {_SEQUENCE.format("query")} AS words FROM log),
    places AS (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS pos FROM texts),
    tried AS (
        SELECT query_id, pos, unnest(range(1, 4)) AS n, array_to_string(words[pos:pos + 2], ' ') AS whole, words FROM places),
    found AS (
        SELECT t.query_id, t.pos, g.n, g.spelled, g.label, g.meaning
        FROM tried t JOIN gazetteer g ON g.n = t.n AND t.pos + t.n - 1 <= len(t.words)
            AND g.spelled = array_to_string(t.words[t.pos:t.pos + t.n - 1], ' ')
        QUALIFY row_number() OVER (PARTITION BY t.query_id, t.pos ORDER BY g.n DESC) = 1),
    picked AS (
        SELECT query_id, min(pos) AS pos FROM found GROUP BY query_id
        UNION ALL
        SELECT p.query_id, (SELECT min(g.pos) FROM found g WHERE g.query_id = p.query_id AND g.pos >= f.pos + f.n)
        FROM picked p JOIN found f ON f.query_id = p.query_id AND f.pos = p.pos),
    listed AS (
        SELECT f.query_id, count(*) AS n_entities,
               string_agg(concat_ws('|', f.spelled, f.label, f.meaning), ';' ORDER BY f.pos) AS entities
        FROM picked p JOIN found f ON f.query_id = p.query_id AND f.pos = p.pos GROUP BY f.query_id)
    SELECT l.query_id, coalesce(n_entities, 0) AS n_entities, coalesce(entities, '') AS entities
    FROM log l LEFT JOIN listed USING (query_id)"""

_TERMS = f""",
    tokens AS (SELECT id, unnest({_SEQUENCE.format("document")}) AS term FROM store),
    tf AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""

SQL = {
    "link_entities": _ENTITIES,
    "term_statistics": R.ctes("store") + _TERMS + " SELECT term, df FROM df",
    "bm25_rerank": _CANDIDATES.replace(R.ctes("store", "search_queries"), R.ctes("store", "search_queries") + _TERMS, 1) + f""",
        sizes AS (SELECT s.id, coalesce(sum(t.tf), 0) AS length FROM store s LEFT JOIN tf t ON t.id = s.id GROUP BY s.id),
        whole AS (SELECT count(*) AS docs, sum(length) / count(*) AS average FROM sizes),
        asked AS (SELECT DISTINCT query_id, unnest({_SEQUENCE.format("query")}) AS term FROM search_queries),
        parts AS (
            SELECT n.query_id, n.id, CAST(round(ln(1 + (w.docs - df.df + 0.5) / (df.df + 0.5)) * 2.2::DOUBLE
                * (tf.tf / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * s.length / w.average))), 6) AS DECIMAL(18, 6)) AS part
            FROM nearest n JOIN asked a ON a.query_id = n.query_id JOIN df ON df.term = a.term
                JOIN tf ON tf.id = n.id AND tf.term = a.term JOIN sizes s ON s.id = n.id CROSS JOIN whole w),
        sums AS (SELECT query_id, id, CAST(sum(part) AS DOUBLE) AS score FROM parts GROUP BY query_id, id)
        SELECT n.query_id, n.id, n.vector_rank, coalesce(s.score, 0.0) AS rerank_score,
               row_number() OVER (PARTITION BY n.query_id ORDER BY coalesce(s.score, 0.0) DESC, n.vector_rank) AS final_rank
        FROM nearest n LEFT JOIN sums s ON s.query_id = n.query_id AND s.id = n.id""",
    "cell_index_search": _CELLS + f"""
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vector_rank, id, distance
        FROM scored WHERE probe <= {NPROBE} QUALIFY vector_rank <= {K}""",
    "cell_index_recall": _CELLS + f""",
        best AS (
            SELECT query_id, id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K}),
        {_BEST} {_RECALL}""",
    "knn_join_voronoi": _nearest(K) + " SELECT query_id, vector_rank, id, distance FROM nearest",
}
