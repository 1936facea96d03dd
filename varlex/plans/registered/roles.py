"""The given tables in the roles the operators need, in Spark and in SQL.

The tables hold no registries, so each is read as one: whole tables, whole
texts.  ``ROLE_SQL`` spells the same roles for the reference SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varlex.operators.ordering import ORD, spread

# Keys that spread a table evenly where it comes as one split.
_EVEN_KEYS = {"documents": "doc_id", "lineitem": "l_orderkey"}
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per application."""
    path = f"{sf_dir}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def even(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table for work that is heavy per row, over all cores if it is one split."""
    return spread(table(spark, sf_dir, name), _EVEN_KEYS[name])


def text(column: str):
    return F.col(column).cast("string")


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# -- dictionaries ----------------------------------------------------------
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; unlabelled ones have real nulls."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def usaid_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary with copies (same text, same id) and nulls in its labels; every text is whole."""
    return labelled(spark, sf_dir).select(
        F.sha2("text", 256).alias("IndicatorId"),
        F.when(F.col("quality").isNotNull(), F.concat_ws(" ", "source", "lang")).alias("Label"),
        F.when(F.col("quality") == 1, F.col("source")).alias("ShortName"),
        F.col("text").alias("Definition"),
        F.col("doc_id").alias(ORD),
    )


def who_model_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        text("doc_id").alias("IndicatorCode"),
        F.col("text").alias("IndicatorName"),
        F.upper("lang").alias("Language"),
        F.col("doc_id").alias(ORD),
    )


def who_hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat_ws("_", "event_type", text("user_id")).alias("IndicatorCode"),
        F.col("props").alias("IndicatorName"),
        F.col("event_id").alias(ORD),
    )


def _turn_order():
    return (F.col("conv_id") * 1000 + F.col("turn")).alias(ORD)


def allofus_model_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that are empty for some rows and concept ids that are null for some."""
    return table(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 2 == 0, text("conv_id")).alias("concept_id"),
        F.when(F.col("role") == "user", F.concat_ws("-", text("conv_id"), text("turn")))
        .otherwise("").alias("question_code"),
        F.col("text").alias("question_text"),
        _turn_order(),
    )


def allofus_hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        text("p_partkey").alias("concept_id"),
        F.col("p_name").alias("concept_name"),
        F.col("p_brand").alias("domain_id"),
        F.col("p_type").alias("vocabulary_id"),
        F.col("p_partkey").alias(ORD),
    )


def mimic_model_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No unit column: it has to be back-filled."""
    return table(spark, sf_dir, "part").select(
        text("p_partkey").alias("itemid"),
        F.col("p_name").alias("label"),
        F.col("p_type").alias("category"),
        F.col("p_partkey").alias(ORD),
    )


def mimic_hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows per item; line items have no unique key, so all fields order them."""
    return table(spark, sf_dir, "lineitem").select(
        text("l_partkey").alias("itemid"),
        F.concat(F.lit("supplied by "), text("l_suppkey")).alias("label"),
        F.col("l_returnflag").alias("fluid"),
        F.col("l_linestatus").alias("category"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
        ).alias(ORD),
    )


def nhanes_model_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("Variable"),
        F.col("c_name").alias("Description"),
        F.col("c_mktsegment").alias("Target"),
        F.col("c_custkey").alias(ORD),
    )


def nhanes_hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn, so every conversation is a duplicated key."""
    return table(spark, sf_dir, "conversations").select(
        text("conv_id").alias("variable_id"),
        F.col("role").alias("sas_label"),
        F.col("text").alias("question_text"),
        _turn_order(),
    )


def ukb_model_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown header spelling, found by the column detector."""
    return table(spark, sf_dir, "supplier").select(
        text("s_nationkey").alias("Nation"),
        text("s_suppkey").alias(" Supplier Field "),
        F.col("s_name").alias("Full TITLE"),
        F.col("s_suppkey").alias(ORD),
    )


def ukb_hash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("field_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("notes"),
        F.col("c_custkey").alias(ORD),
    )


def model_landed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "usaid": usaid_raw(spark, sf_dir),
        "who": who_model_raw(spark, sf_dir),
        "nih_allofus": allofus_model_raw(spark, sf_dir),
        "mimic_iv": mimic_model_raw(spark, sf_dir),
        "nhanes": nhanes_model_raw(spark, sf_dir),
        "uk_biobank": ukb_model_raw(spark, sf_dir),
    }


def hash_landed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "usaid": usaid_raw(spark, sf_dir),
        "who": who_hash_raw(spark, sf_dir),
        "mimic_iv": mimic_hash_raw(spark, sf_dir),
        "nih_allofus": allofus_hash_raw(spark, sf_dir),
        "nhanes": nhanes_hash_raw(spark, sf_dir),
        "uk_biobank": ukb_hash_raw(spark, sf_dir),
    }


def unified_landed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    documents = labelled(spark, sf_dir).select(
        F.when(F.col("quality").isNotNull(), F.col("source")).alias("Component"),
        text("doc_id").alias("Item/Code"),
        F.col("text").alias("Description"),
    )
    parts = table(spark, sf_dir, "part").select(
        text("p_partkey").alias("FieldID"),
        F.col("p_name").alias("Title"),
        F.col("p_type").alias("Description"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("Category"),
    )
    return {"nhanes": documents, "uk_biobank": parts}


# -- vector store and queries ----------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as a corpus: id, source, vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), text("label").alias("source"), F.col("embedding").alias("vector")
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as queries; a third ask one source, a third two, a third all."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.when(F.col("vec_id") % 3 == 0, F.array(label.cast("string")))
        .when(F.col("vec_id") % 3 == 1,
              F.array(label.cast("string"), ((label + 1) % 10).cast("string")))
        .otherwise(F.array()).alias("sources"),
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the documents of the same number as store rows.

    Sources are missing for one label, and the metadata keys differ by label as
    they do between registries.
    """
    label = F.col("label")
    source = F.when(label != 9, F.concat(F.lit("src"), label.cast("string")))
    number = text("vec_id")
    name = F.concat(F.lit("name "), number)
    keys = (
        F.when(label % 3 == 0, F.create_map(F.lit("field_id"), number, F.lit("title"), name))
        .when(label % 3 == 1, F.create_map(F.lit("label"), name, F.lit("short_name"), F.lit("")))
        .otherwise(F.create_map(F.lit("short_name"), name))
    )
    with_source = F.when(
        label != 9, F.map_concat(keys, F.create_map(F.lit("source"), source))
    ).otherwise(keys)
    joined = table(spark, sf_dir, "embeddings").join(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"),
        "vec_id", "left",
    )
    return joined.select(
        F.concat(F.lit("v"), number).alias("id"),
        source.alias("source"),
        F.when(label % 4 != 0, number).alias("indicator_id"),
        name.alias("short_name"),
        F.coalesce("text", F.lit("")).alias("document"),
        F.col("embedding").alias("vector"),
        with_source.alias("metadata"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as queries with their own filters, cut-offs and sizes."""
    item = F.col("item_id")
    bench = table(spark, sf_dir, "benchmark")
    joined = bench.join(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id"
    )
    one = F.concat(F.lit("src"), (item % 9).cast("string"))
    two = F.concat(F.lit("src"), ((item + 4) % 9).cast("string"))
    return joined.select(
        item.alias("query_id"),
        F.col("text").alias("query"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.when(item % 4 == 1, F.array(one)).when(item % 4 == 2, F.array(one, two))
        .otherwise(F.array().cast("array<string>")).alias("sources"),
        (F.lit(1.2) + (item % 5) * F.lit(0.1)).alias("max_dist"),
        (item % 10 + 1).cast("int").alias("n"),
    )


# -- observations ----------------------------------------------------------
def who_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(
        text("l_partkey").alias("variable_id"),
        F.col("l_suppkey").alias("SpatialDim"),
        F.year("l_shipdate").cast("bigint").alias("TimeDim"),
        F.col("l_quantity").alias("NumericValue"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("Value"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate",
            "l_returnflag", "l_linestatus",
        ).alias(ORD),
    )


def dhs_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        text("o_custkey").alias("variable_id"),
        F.col("o_orderstatus").alias("CountryName"),
        F.year("o_orderdate").cast("bigint").alias("SurveyYear"),
        text("o_orderkey").alias("Value"),
        F.col("o_orderpriority").alias("CharacteristicLabel"),
        F.col("o_orderkey").alias(ORD),
    )


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as participants; one market segment is the default wide table."""
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.when(segment == "HOUSEHOLD", "DEMO_J").otherwise(segment).alias("table_id"),
        F.col("c_custkey").alias("SEQN"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.col("c_custkey").alias(ORD),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a match: four families, some ids missing, some repeated."""
    key, size = F.col("p_partkey"), F.col("p_size")
    family = (
        F.when(size % 4 == 0, " Who_GHO ").when(size % 4 == 1, "USAID_DHS")
        .when(size % 4 == 2, "cdc_nhanes").otherwise("mimic_iv")
    )
    code = (
        F.when(size % 4 == 2, F.when(size % 8 == 2, "c_acctbal").otherwise("c_nationkey"))
        .otherwise((key - key % 2).cast("string"))
    )
    return table(spark, sf_dir, "part").select(
        key.alias("target_ordinal"),
        F.when(size == 7, "").when(size == 8, "N/A").otherwise(code).alias("variable_id"),
        F.when(size % 3 == 0, "N/A").when(size % 3 == 1, "building").otherwise("machinery").alias("table_id"),
        family.alias("source_dataset"),
    )


ROLE_SQL = {
    "usaid_raw": """
        SELECT sha256(d.text) AS IndicatorId,
               CASE WHEN l.quality IS NOT NULL THEN d.source || ' ' || d.lang END AS Label,
               CASE WHEN l.quality = 1 THEN d.source END AS ShortName,
               d.text AS Definition,
               d.doc_id AS ord
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "vectors": """
        SELECT vec_id AS id, CAST(label AS VARCHAR) AS source, CAST(embedding AS DOUBLE[]) AS vector
        FROM embeddings""",
    "vector_queries": """
        SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vector,
               CASE WHEN vec_id % 3 = 0 THEN [CAST(label AS VARCHAR)]
                    WHEN vec_id % 3 = 1 THEN [CAST(label AS VARCHAR), CAST((label + 1) % 10 AS VARCHAR)]
               END AS sources
        FROM embeddings""",
    "store": """
        SELECT 'v' || e.vec_id AS id,
               CASE WHEN e.label <> 9 THEN 'src' || e.label END AS source,
               CASE WHEN e.label % 4 <> 0 THEN CAST(e.vec_id AS VARCHAR) END AS indicator_id,
               coalesce(d.text, '') AS document,
               CAST(e.embedding AS DOUBLE[]) AS vector,
               coalesce(CASE WHEN e.label <> 9 THEN 'src' || e.label END, 'unknown') AS r_source,
               CASE e.label % 3 WHEN 0 THEN CAST(e.vec_id AS VARCHAR)
                                WHEN 1 THEN 'name ' || e.vec_id ELSE 'N/A' END AS r_table,
               CASE e.label % 3 WHEN 0 THEN CAST(e.vec_id AS VARCHAR)
                                WHEN 1 THEN '' ELSE 'name ' || e.vec_id END AS r_variable,
               'name ' || e.vec_id AS r_name
        FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "search_queries": """
        SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS vector,
               CASE WHEN b.item_id % 4 = 1 THEN ['src' || (b.item_id % 9)]
                    WHEN b.item_id % 4 = 2 THEN ['src' || (b.item_id % 9), 'src' || ((b.item_id + 4) % 9)]
               END AS sources,
               1.2::DOUBLE + (b.item_id % 5) * 0.1::DOUBLE AS max_dist,
               b.item_id % 10 + 1 AS n
        FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
    "who_rows": """
        SELECT CAST(l_partkey AS VARCHAR) AS variable_id, l_suppkey AS SpatialDim,
               year(l_shipdate) AS TimeDim, l_quantity AS NumericValue,
               l_returnflag || '/' || l_linestatus AS Value,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey,
                   l_quantity, l_shipdate, l_returnflag, l_linestatus) AS observation_rank
        FROM lineitem""",
    "dhs_rows": """
        SELECT CAST(o_custkey AS VARCHAR) AS variable_id, o_orderstatus AS CountryName,
               year(o_orderdate) AS SurveyYear, CAST(o_orderkey AS VARCHAR) AS Value,
               o_orderpriority AS CharacteristicLabel,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS observation_rank
        FROM orders""",
    "wide_long": """
        SELECT table_id, variable_id, SEQN, value,
               row_number() OVER (PARTITION BY table_id, variable_id ORDER BY SEQN) AS observation_rank
        FROM (SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'DEMO_J' ELSE c_mktsegment END AS table_id,
                     'c_acctbal' AS variable_id, c_custkey AS SEQN, c_acctbal AS value
              FROM customer WHERE c_acctbal > 0
              UNION ALL
              SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'DEMO_J' ELSE c_mktsegment END,
                     'c_nationkey', c_custkey, CAST(c_nationkey AS DOUBLE)
              FROM customer WHERE c_nationkey IS NOT NULL)""",
    "records": """
        SELECT p_partkey AS target_ordinal,
               CASE WHEN p_size = 7 THEN '' WHEN p_size = 8 THEN 'N/A'
                    WHEN p_size % 4 = 2 THEN CASE WHEN p_size % 8 = 2 THEN 'c_acctbal' ELSE 'c_nationkey' END
                    ELSE CAST(p_partkey - p_partkey % 2 AS VARCHAR) END AS variable_id,
               CASE p_size % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'building' ELSE 'machinery' END AS table_id,
               CASE p_size % 4 WHEN 0 THEN ' Who_GHO ' WHEN 1 THEN 'USAID_DHS'
                               WHEN 2 THEN 'cdc_nhanes' ELSE 'mimic_iv' END AS source_dataset
        FROM part""",
}


def ctes(*names: str) -> str:
    """A WITH clause of roles, open for more."""
    return "WITH " + ",\n".join(f"{name} AS ({ROLE_SQL[name]})" for name in names)
