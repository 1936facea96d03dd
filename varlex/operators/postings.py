"""An inverted index of stored documents: BM25 scores of search candidates by joins.

Layout below one folder, every batch in folders of its own::

    postings/batch=/bucket=     bucket by term: term, id, tf
    documents/batch=/bucket=    bucket by id: id, length, terms
    statistics/batch=           term, df      changes, summed by the reader
    totals/batch=               docs, length  changes, summed by the reader

A document that comes again replaces its older self: the batch takes the old
terms back out of the statistics, and postings count only with the batch that
holds their document last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varlex.operators.gazetteer import word_sequence
from varlex.operators.ordering import dedup_keep_last
from varlex.session import path_exists

BUCKETS = 64
# The usual saturation and length parameters.
K1, B = 1.2, 0.75
SCORE_DIGITS = 6


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    if not path_exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def stored_documents(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(id, batch, length, terms) of the current version of every document."""
    rows = _read(spark, path, "documents", "id string, length long, terms array<string>, batch int, bucket int")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("id").agg(F.max_by(F.struct("batch", "length", "terms"), "batch").alias("last")).select("id", "last.*")


def next_batch(spark: SparkSession, path: str) -> int:
    """The number behind the last one written."""
    return (_read(spark, path, "totals", "docs long, length long, batch int").agg(F.max("batch")).first()[0] or 0) + 1


def add_documents(
    spark: SparkSession, docs: DataFrame, path: str, id_column: str = "id", text: str = "document", order: str | None = None,
    buckets: int = BUCKETS, batch: int | None = None,
) -> int:
    """Index a batch of documents; those that are in the index already are replaced.  Returns the batch's number.

    Of equal ids the last in ``order`` counts (without it, the largest text).
    Null texts have no terms.  Writing a batch of a given number again gives
    the same files, so a failed batch can be repeated.  One writer at a time.
    """
    number = next_batch(spark, path) if batch is None else batch
    rows = docs.select(
        F.col(id_column).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("document"),
        (F.col(order) if order else F.coalesce(text, F.lit(""))).alias("_place"),
    )
    latest = dedup_keep_last(rows, ["id"], "_place").drop("_place")
    counted = latest.select("id", F.explode(word_sequence("document")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    folders = {t: f"{path}/{t}/batch={number}" for t in ("postings", "documents", "statistics", "totals")}
    counted.withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folders["postings"])
    postings = spark.read.parquet(folders["postings"]).select("id", "term", "tf")
    with_terms = latest.select("id").join(
        postings.groupBy("id").agg(F.sum("tf").alias("length"), F.collect_list("term").alias("terms")), "id", "left"
    ).select("id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    with_terms.withColumn("bucket", _bucket("id", buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folders["documents"])
    new = spark.read.parquet(folders["documents"]).select("id", "length", "terms")
    old = stored_documents(spark, path, before=number).join(new.select("id"), "id", "left_semi").select("id", "length", "terms")
    change = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    change.select(F.explode("terms").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).where("df != 0").write.mode(
        "overwrite").parquet(folders["statistics"])
    # Written last: a batch without its totals isn't there yet.
    change.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("length")).write.mode(
        "overwrite").parquet(folders["totals"])
    return number


def term_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(term, df): how many current documents hold each term."""
    changes = _read(spark, path, "statistics", "term string, df long, batch int")
    return changes.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def bm25_scores(spark: SparkSession, candidates: DataFrame, path: str, query: str = "query", buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id, rerank_score): the BM25 score of each candidate (query_id, id, query text).

    A term of the query counts once; a candidate without any of them, or that
    isn't in the index, has 0.  Terms are scored to six digits and summed as
    decimals, so the order of rows doesn't show.  Only the buckets of the
    queries' terms are read, of them the candidates' postings are kept.
    """
    pairs = candidates.select("query_id", F.col("id").cast("string").alias("id")).distinct()
    asked = candidates.select("query_id", query).distinct().select("query_id", F.explode(F.array_distinct(word_sequence(query))).alias("term")).distinct()
    df = term_statistics(spark, path).join(asked.select("term").distinct(), "term")
    totals = _read(spark, path, "totals", "docs long, length long, batch int").agg(F.sum("docs").alias("docs"), F.sum("length").alias("all"))
    count = totals.first()
    docs, average = count["docs"] or 0, (count["all"] or 0) / max(1, count["docs"] or 0)
    idf = F.log(1 + (F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    wanted = pairs.join(terms, "query_id")
    # No more buckets than the index has.
    places = [r[0] for r in asked.select(_bucket("term", buckets).alias("b")).distinct().collect()]
    postings = _read(spark, path, "postings", "term string, id string, tf long, batch int, bucket int").where(F.col("bucket").isin(places))
    current = stored_documents(spark, path).select("id", "batch", "length")
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
    scored = wanted.join(postings.drop("bucket"), ["id", "term"]).join(current, ["id", "batch"]).select(
        "query_id", "id", F.round(F.col("idf") * (K1 + 1) * share, SCORE_DIGITS).cast("decimal(18,6)").alias("part")
    )
    sums = scored.groupBy("query_id", "id").agg(F.sum("part").cast("double").alias("rerank_score"))
    return pairs.join(sums, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"))


def bm25_rerank(spark: SparkSession, candidates: DataFrame, path: str, query: str = "query", **options) -> DataFrame:
    """Candidates with ``rerank_score`` by BM25 and ``final_rank``; equal scores keep the order of ``vector_rank``."""
    found = bm25_scores(spark, candidates, path, query, **options).withColumnsRenamed({"id": "_id", "query_id": "_query_id"})
    same = F.col("query_id").eqNullSafe(F.col("_query_id")) & (F.col("id").cast("string") == F.col("_id"))
    scored = candidates.join(found, same).drop("_id", "_query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("vector_rank").asc())
    return scored.withColumn("final_rank", F.row_number().over(order))
