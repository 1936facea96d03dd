"""Harmonisation operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions import text as X
from varlex.operators import harmonise as H
from varlex.operators import ordering as O
from varlex.operators import report
from varlex.operators.ordering import ORD
from varlex.plans.ingest import harmonise, harmonise_unified
from varlex.plans.registered import roles as R
from varlex.specs import HASH_SPECS, MODEL_SPECS


def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = R.mimic_model_raw(spark, sf_dir).drop(ORD)
    return H.rename_columns(raw, HASH_SPECS["mimic_iv"].rename)


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fill_defaults(R.usaid_raw(spark, sf_dir), HASH_SPECS["usaid"].fill).drop(ORD)


def fill_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fill_blank(R.usaid_raw(spark, sf_dir)).drop(ORD)


def backfill_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = MODEL_SPECS["mimic_iv"]
    return H.backfill_missing_columns(R.mimic_model_raw(spark, sf_dir), spec.backfill).drop(ORD)


def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.detect_columns(R.ukb_model_raw(spark, sf_dir)).drop(ORD)


def normalise_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.normalise_column_names(R.ukb_model_raw(spark, sf_dir)).drop(ORD)


def tag_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return H.tag_source(parts, MODEL_SPECS["mimic_iv"].source)


def cast_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return H.cast_string(orders, ["o_orderkey", "o_custkey"])


def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the chosen registries are planned."""
    landed = R.hash_landed(spark, sf_dir)
    return harmonise(spark, landed, HASH_SPECS, ["nhanes", "who"]).select("id", "source", "document")


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = R.allofus_model_raw(spark, sf_dir)
    return R.longs(O.row_index(turns), "row_index").select(F.col(ORD).alias("ord"), "row_index")


def scan_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of a file scan, without any order column."""
    scan = O.with_scan_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return R.longs(O.scan_row_index(scan), "row_index").select("doc_id", "row_index")


def project_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.project_canonical(R.usaid_raw(spark, sf_dir), MODEL_SPECS["usaid"].columns)


def project_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.project_available(R.who_rows(spark, sf_dir), fixed.WHO_COLUMNS)


def prefix_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unified_landed(spark, sf_dir)["uk_biobank"].select(
        "FieldID", X.prefix_concat("Cat", "Category").alias("table_id")
    )


def synth_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    unified = harmonise_unified(R.unified_landed(spark, sf_dir))
    return H.unified_store_rows(unified).select("id", "source", "indicator_id")


def first_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usaid_raw(spark, sf_dir).select(
        F.col(ORD).alias("doc_id"), X.first_truthy("Definition", "Label", "IndicatorId").alias("text")
    )


def render_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = H.fill_defaults(R.usaid_raw(spark, sf_dir), HASH_SPECS["usaid"].fill)
    return filled.select(
        F.col(ORD).alias("doc_id"), X.render(HASH_SPECS["usaid"].document).alias("document")
    )


def truncate_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", X.truncate("text").alias("short_name"))


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies share an id; the first one stays, with all its columns."""
    kept = O.dedup_keep_first(R.usaid_raw(spark, sf_dir), ["IndicatorId"])
    return kept.withColumnRenamed(ORD, "doc_id")


def cap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 line items per supplier and return flag in input order."""
    rows = R.even(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias(ORD),
    )
    return O.cap_rows(rows, 30, ["l_suppkey", "l_returnflag"], lanes=4).drop(ORD)


def filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.filter_language(R.who_model_raw(spark, sf_dir), "EN").drop(ORD)


def union_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = R.unified_landed(spark, sf_dir)
    return H.union_registries(
        [H.to_unified(df, fixed.UNIFIED_REGISTRIES[key]) for key, df in landed.items()]
    )


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), R.text("page_id")).alias("key"), F.col("html").alias("text")
    )
    documents = R.even(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), R.text("doc_id")).alias("key"), "text"
    )
    return pages.unionByName(documents).select("key", X.clean_text("text").alias("cleaned"))


def composite_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonise_unified(R.unified_landed(spark, sf_dir))


def metadata_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = MODEL_SPECS["usaid"]
    rows = H.fill_blank(R.usaid_raw(spark, sf_dir)).select(
        F.col(ORD).alias("doc_id"), H.metadata_map(spec.source, spec.metadata).alias("metadata")
    )
    return rows.select("doc_id", F.explode("metadata"))


def enforce_unified_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose variable id or source is missing are rejected."""
    rows = R.labelled(spark, sf_dir).select(
        F.when(F.col("quality").isNotNull(), F.col("source")).alias("source_dataset"),
        F.col("lang").alias("table_id"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, R.text("doc_id")).alias("variable_id"),
        R.text("doc_id").alias("variable_name"),
        F.col("text").alias("description"),
    )
    valid, rejected = H.enforce_unified_schema(rows)
    return valid.withColumn("state", F.lit("valid")).unionByName(
        rejected.withColumn("state", F.lit("rejected"))
    )


def harmonise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six registries of different shape through the labelled-default specs."""
    return harmonise(spark, R.hash_landed(spark, sf_dir), HASH_SPECS).drop("metadata")


def harmonise_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six registries of different shape through the blank-fill specs."""
    rows = harmonise(spark, R.model_landed(spark, sf_dir), MODEL_SPECS)
    return rows.withColumn("metadata", F.array_join(F.array_sort(F.transform(
        F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )), "; "))


def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_records(harmonise(spark, R.hash_landed(spark, sf_dir), HASH_SPECS))


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_sources(R.store(spark, sf_dir))


def count_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.count_sources(R.store(spark, sf_dir))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ingest_counts(harmonise(spark, R.model_landed(spark, sf_dir), MODEL_SPECS))


QUERIES = {
    fn.__name__: fn
    for fn in (
        rename_columns, fill_defaults, fill_blank, backfill_missing_columns, detect_columns,
        normalise_column_names, tag_source, cast_string, source_selection,
        row_index, scan_row_index, project_canonical, project_available, prefix_concat, synth_id,
        first_truthy, render_document, truncate_100, dedup_keep_first, cap_rows, filter_language,
        union_registries, clean_text, composite_text, metadata_map, enforce_unified_schema,
        harmonise_model, count_records, distinct_sources, count_sources, ingest_report,
    )
} | {"harmonise": harmonise_hash}

_UNIFIED = """
    WITH unified AS (
        SELECT 'NHANES' AS source_dataset,
               CASE WHEN l.quality IS NOT NULL THEN d.source END AS table_id,
               CAST(d.doc_id AS VARCHAR) AS variable_id, CAST(d.doc_id AS VARCHAR) AS variable_name,
               d.text AS description
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        UNION ALL
        SELECT 'UK_Biobank', concat_ws('_', 'Cat', CASE WHEN p_size > 10 THEN p_brand END),
               CAST(p_partkey AS VARCHAR), p_name, p_type
        FROM part)"""

_COMPOSITE = """concat_ws(' | ', source_dataset, trim(lower(variable_name)),
    trim(lower(regexp_replace(description, '[^a-zA-Z0-9\\s\\-_]', '', 'g'))))"""

_HASH = R.ctes("usaid_raw") + """,
    usaid AS (
        SELECT IndicatorId, coalesce(Label, 'Unknown Indicator') AS Label,
               coalesce(ShortName, 'Unknown Short Label') AS ShortName,
               coalesce(Definition, 'No Context Clarified') AS Definition
        FROM usaid_raw QUALIFY row_number() OVER (PARTITION BY IndicatorId ORDER BY ord) = 1),
    who AS (
        SELECT * FROM (
            SELECT event_type || '_' || user_id AS Code, props AS Name, event_id AS ord FROM events
            QUALIFY row_number() OVER (PARTITION BY event_type || '_' || user_id ORDER BY event_id) = 1)),
    mimic AS (
        SELECT * FROM (
            SELECT CAST(l_partkey AS VARCHAR) AS ItemID, 'supplied by ' || l_suppkey AS Label,
                   l_returnflag AS Fluid, l_linestatus AS Category, l_orderkey, l_linenumber, l_partkey, l_suppkey
            FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey,
                l_suppkey, l_returnflag, l_linestatus) = 1)),
    allofus AS (SELECT * FROM part),
    nhanes AS (
        SELECT * FROM (
            SELECT CAST(conv_id AS VARCHAR) AS VariableID, role, text, conv_id, turn FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)),
    ukb AS (SELECT * FROM customer),
    harmonised AS (
        SELECT 'DHS_' || IndicatorId AS id, 'USAID_DHS' AS source, IndicatorId AS indicator_id, ShortName AS short_name,
               'Source: USAID DHS | Indicator: ' || Label || ' | Definition: '
                   || CASE WHEN Definition <> '' THEN Definition ELSE Label END AS document
        FROM usaid
        UNION ALL
        SELECT 'WHO_GHO_' || Code, 'WHO_GHO', Code, substring(Name, 1, 100),
               'Source: WHO GHO | Indicator Code: ' || Code || ' | Name: ' || Name FROM who
        UNION ALL
        SELECT 'MIMIC_ITEM_' || ItemID, 'MIMIC_IV', ItemID, substring(Label, 1, 100),
               'Source: MIMIC-IV | ItemID: ' || ItemID || ' | Label: ' || Label || ' | Fluid: ' || Fluid
                   || ' | Category: ' || Category FROM mimic
        UNION ALL
        SELECT 'ALLOFUS_CONCEPT_' || p_partkey, 'NIH_ALLOFUS', CAST(p_partkey AS VARCHAR), substring(p_name, 1, 100),
               'Source: NIH All of Us | Concept ID: ' || p_partkey || ' | Name: ' || p_name || ' | Domain: '
                   || p_brand || ' | Vocabulary: ' || p_type FROM allofus
        UNION ALL
        SELECT 'NHANES_VAR_' || VariableID, 'NHANES', VariableID, substring(role, 1, 100),
               'Source: CDC NHANES | Variable: ' || VariableID || ' | Label: ' || role || ' | Question: ' || text
        FROM nhanes
        UNION ALL
        SELECT 'UKB_FIELD_' || c_custkey, 'UK_Biobank', CAST(c_custkey AS VARCHAR), substring(c_name, 1, 100),
               'Source: UK Biobank | Field ID: ' || c_custkey || ' | Category: ' || c_mktsegment
                   || ' | Description: ' || c_name FROM ukb)"""

_MODEL = R.ctes("usaid_raw") + """,
    usaid AS (
        SELECT IndicatorId, coalesce(Label, '') AS Label, coalesce(ShortName, '') AS ShortName,
               coalesce(Definition, '') AS Definition
        FROM usaid_raw QUALIFY row_number() OVER (PARTITION BY IndicatorId ORDER BY ord) = 1),
    turns AS (
        SELECT CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS concept_id,
               CASE WHEN role = 'user' THEN conv_id || '-' || turn ELSE '' END AS question_code, text,
               row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx
        FROM conversations),
    allofus AS (
        SELECT *, coalesce(nullif(question_code, ''), nullif(concept_id, ''), CAST(idx AS VARCHAR)) AS code FROM turns),
    harmonised AS (
        SELECT 'usaid_' || IndicatorId AS id, 'usaid_dhs' AS source, IndicatorId AS indicator_id,
               ShortName AS short_name,
               'Source: USAID DHS. Label: ' || Label || '. Definition: ' || Definition AS document,
               'label=' || Label || '; short_name=' || ShortName || '; source=usaid_dhs' AS metadata
        FROM usaid
        UNION ALL
        SELECT 'who_' || doc_id, 'who_gho', CAST(doc_id AS VARCHAR), substring(text, 1, 100),
               'Source: WHO GHO. Indicator Code: ' || doc_id || '. Indicator Name: ' || text,
               'indicator_id=' || doc_id || '; short_name=' || substring(text, 1, 100) || '; source=who_gho'
        FROM documents WHERE lang = 'en'
        UNION ALL
        SELECT 'allofus_' || code, 'nih_allofus', code, substring(text, 1, 100),
               'Source: NIH All of Us. Concept ID: ' || concept_id || '. Question Code: ' || question_code
                   || '. Text: ' || text,
               'concept_id=' || concept_id || '; short_name=' || substring(text, 1, 100) || '; source=nih_allofus'
        FROM allofus
        UNION ALL
        SELECT 'mimic_' || p_partkey, 'mimic_iv', CAST(p_partkey AS VARCHAR), substring(p_name, 1, 100),
               'Source: MIMIC-IV. Item ID: ' || p_partkey || '. Label: ' || p_name || '. Category: ' || p_type
                   || '. Unit: ',
               'item_id=' || p_partkey || '; short_name=' || substring(p_name, 1, 100) || '; source=mimic_iv'
        FROM part
        UNION ALL
        SELECT 'nhanes_' || c_custkey, 'cdc_nhanes', CAST(c_custkey AS VARCHAR), substring(c_name, 1, 100),
               'Source: CDC NHANES. Variable: ' || c_custkey || '. Description: ' || c_name
                   || '. Target Demographic: ' || c_mktsegment,
               'short_name=' || substring(c_name, 1, 100) || '; source=cdc_nhanes; variable=' || c_custkey
        FROM customer
        UNION ALL
        SELECT 'ukbb_' || s_suppkey, 'uk_biobank', CAST(s_suppkey AS VARCHAR), s_name,
               'Source: UK Biobank. Field ID: ' || s_suppkey || '. Title: ' || s_name,
               'field_id=' || s_suppkey || '; source=uk_biobank; title=' || s_name
        FROM supplier)"""

SQL = {
    "rename_columns": """
        SELECT CAST(p_partkey AS VARCHAR) AS ItemID, p_name AS Label, p_type AS Category FROM part""",
    "fill_defaults": R.ctes("usaid_raw") + """
        SELECT IndicatorId, coalesce(Label, 'Unknown Indicator') AS Label,
               coalesce(ShortName, 'Unknown Short Label') AS ShortName,
               coalesce(Definition, 'No Context Clarified') AS Definition
        FROM usaid_raw""",
    "fill_blank": R.ctes("usaid_raw") + """
        SELECT IndicatorId, coalesce(Label, '') AS Label, coalesce(ShortName, '') AS ShortName,
               coalesce(Definition, '') AS Definition
        FROM usaid_raw""",
    "backfill_missing_columns": """
        SELECT CAST(p_partkey AS VARCHAR) AS itemid, p_name AS label, p_type AS category, '' AS unitname
        FROM part""",
    "detect_columns": """
        SELECT CAST(s_suppkey AS VARCHAR) AS field_id, s_name AS title FROM supplier""",
    "normalise_column_names": """
        SELECT CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey AS VARCHAR) AS "supplier field",
               s_name AS "full title"
        FROM supplier""",
    "tag_source": "SELECT p_partkey, p_name, 'mimic_iv' AS source FROM part",
    "cast_string": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus
        FROM orders""",
    "source_selection": _HASH + """
        SELECT id, source, document FROM harmonised WHERE source IN ('NHANES', 'WHO_GHO')""",
    "row_index": """
        SELECT conv_id * 1000 + turn AS ord, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index
        FROM conversations""",
    "scan_row_index": """
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents""",
    "project_canonical": R.ctes("usaid_raw") + """
        SELECT IndicatorId, Label, Definition, ShortName FROM usaid_raw""",
    "project_available": R.ctes("who_rows") + """
        SELECT variable_id, SpatialDim, TimeDim, NumericValue, Value FROM who_rows""",
    "prefix_concat": """
        SELECT CAST(p_partkey AS VARCHAR) AS FieldID,
               concat_ws('_', 'Cat', CASE WHEN p_size > 10 THEN p_brand END) AS table_id
        FROM part""",
    "synth_id": _UNIFIED + """
        SELECT source_dataset || '_' || coalesce(table_id, 'None') || '_' || variable_id AS id,
               source_dataset AS source, variable_id AS indicator_id
        FROM unified""",
    "first_truthy": R.ctes("usaid_raw") + """
        SELECT ord AS doc_id, coalesce(nullif(Definition, ''), nullif(Label, ''), IndicatorId) AS text
        FROM usaid_raw""",
    "render_document": R.ctes("usaid_raw") + """
        SELECT ord AS doc_id,
               'Source: USAID DHS | Indicator: ' || coalesce(Label, 'Unknown Indicator') || ' | Definition: '
               || CASE WHEN Definition = '' THEN coalesce(Label, 'Unknown Indicator')
                       ELSE coalesce(Definition, 'No Context Clarified') END AS document
        FROM usaid_raw""",
    "truncate_100": "SELECT doc_id, substring(text, 1, 100) AS short_name FROM documents",
    "dedup_keep_first": R.ctes("usaid_raw") + """
        SELECT IndicatorId, Label, ShortName, Definition, ord AS doc_id FROM usaid_raw
        QUALIFY row_number() OVER (PARTITION BY IndicatorId ORDER BY ord) = 1""",
    "cap_rows": """
        SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) <= 30""",
    "filter_language": """
        SELECT CAST(doc_id AS VARCHAR) AS IndicatorCode, text AS IndicatorName, upper(lang) AS Language
        FROM documents WHERE lang = 'en'""",
    "union_registries": _UNIFIED + " SELECT * FROM unified",
    "clean_text": """
        SELECT key, trim(lower(regexp_replace(text, '[^a-zA-Z0-9\\s\\-_]', '', 'g'))) AS cleaned
        FROM (SELECT 'p' || page_id AS key, html AS text FROM pages
              UNION ALL SELECT 'd' || doc_id, text FROM documents)""",
    "composite_text": _UNIFIED + f" SELECT *, {_COMPOSITE} AS composite_text FROM unified",
    "metadata_map": R.ctes("usaid_raw") + """
        SELECT ord AS doc_id, 'source' AS key, 'usaid_dhs' AS value FROM usaid_raw
        UNION ALL SELECT ord, 'label', coalesce(Label, '') FROM usaid_raw
        UNION ALL SELECT ord, 'short_name', coalesce(ShortName, '') FROM usaid_raw""",
    "enforce_unified_schema": """
        SELECT *, CASE WHEN source_dataset IS NULL OR variable_id IS NULL THEN 'rejected' ELSE 'valid' END AS state
        FROM (SELECT CASE WHEN l.quality IS NOT NULL THEN d.source END AS source_dataset, d.lang AS table_id,
                     CASE WHEN coalesce(l.toxic, 0) = 0 THEN CAST(d.doc_id AS VARCHAR) END AS variable_id,
                     CAST(d.doc_id AS VARCHAR) AS variable_name, d.text AS description
              FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "harmonise": _HASH + " SELECT * FROM harmonised",
    "harmonise_model": _MODEL + " SELECT * FROM harmonised",
    "count_records": _HASH + " SELECT count(*) AS n_records FROM harmonised",
    "distinct_sources": """
        SELECT DISTINCT CASE WHEN label = 9 THEN 'unknown' ELSE 'src' || label END AS source FROM embeddings""",
    "count_sources": "SELECT count(DISTINCT label) AS n_sources FROM embeddings",
    "ingest_report": _MODEL + """
        SELECT source, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM harmonised GROUP BY source""",
    "scan_processed": _UNIFIED + f" SELECT *, {_COMPOSITE} AS composite_text FROM unified",
    "export_csv": _HASH + """
        SELECT id, source, document FROM harmonised WHERE source IN ('MIMIC_IV', 'UK_Biobank')""",
}
