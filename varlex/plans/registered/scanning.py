"""Sources and sinks, exercised on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex import fixed
from varlex.operators.ordering import ORD
from varlex.plans.ingest import harmonise, harmonise_unified
from varlex.plans.landed import Landing
from varlex.plans.landed import ingest_landed as ingest_files
from varlex.plans.registered import roles as R
from varlex.session import fresh_path
from varlex.sources import bucket_store, dictionaries, files, landing, sinks, stores
from varlex.specs import HASH_SPECS


def _pages(df: DataFrame, order: str, key: str, columns: list[str]) -> DataFrame:
    """Rows packed into JSON envelopes of at most one page each."""
    page = F.floor(F.col(order) / fixed.PAGE_ROWS).alias("page")
    items = F.sort_array(F.collect_list(F.struct(order, *columns)))
    rows = F.transform(items, lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return df.groupBy(page).agg(F.to_json(F.struct(rows.alias(key))).alias("value"))


def scan_json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "envelope")
    _pages(R.usaid_raw(spark, sf_dir), ORD, "Data", ["IndicatorId", "Label", "Definition"]).select(
        "value"
    ).write.text(path)
    scan = files.scan_json_envelope(
        spark, path, "Data", ["IndicatorId", "Label", "Definition"], multi_line=False
    )
    return scan.drop(ORD)


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes and line breaks, nulls as empty fields."""
    path = fresh_path(spark, "csv")
    raw = R.labelled(spark, sf_dir).select(
        R.text("doc_id").alias("doc_id"), "text", R.text("quality").alias("quality")
    )
    raw.write.options(
        header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return files.scan_csv(spark, path, ["doc_id", "text", "quality"], multi_line=True).drop(ORD)


def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tsv")
    R.allofus_hash_raw(spark, sf_dir).drop(ORD).write.options(header=True, sep="\t").csv(path)
    return files.scan_tsv(spark, path).drop(ORD)


def scan_ragged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs or double blanks; long rows are skipped, short ones padded."""
    path = fresh_path(spark, "ragged")
    key, nation = R.text("c_custkey"), R.text("c_nationkey")
    line = (
        F.when(F.col("c_nationkey") % 5 == 0, F.concat_ws("\t", key, "c_name", nation, nation))
        .when(F.col("c_nationkey") % 5 == 1, F.concat(key, F.lit("   "), F.col("c_name")))
        .otherwise(F.concat(key, F.lit("\t\t"), F.col("c_name"), F.lit("  "), nation))
    )
    R.table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return files.scan_ragged_text(spark, path, ["field_id", "title", "nation"]).drop(ORD)


def scan_json_or_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of JSON page files and CSV files; the scan tells them apart."""
    path = fresh_path(spark, "mixed")
    documents = R.who_model_raw(spark, sf_dir)
    names = ["IndicatorCode", "IndicatorName"]
    _pages(documents.where(F.col("Language") == "EN"), ORD, "value", names).withColumnRenamed(
        "value", "payload"
    ).write.partitionBy("page").text(f"{path}/json")
    sinks.export_csv(documents.where(F.col("Language") != "EN").select(*names), f"{path}/csv")
    return files.scan_json_or_csv(spark, [f"{path}/json", f"{path}/csv"], "value", names).drop(ORD)


def scan_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of CSV files with two orders of columns, a TSV file and JSON pages, settled file by file."""
    path = fresh_path(spark, "dictionary")
    raw = R.labelled(spark, sf_dir).select(R.text("doc_id").alias("doc_id"), "text", R.text("quality").alias("quality"))
    kind = F.col("doc_id").cast("long") % 4
    quoted = dict(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quoteAll=True
    )
    raw.where(kind == 0).write.options(**quoted).csv(f"{path}/a")
    raw.where(kind == 1).select("quality", "text", F.lit("more").alias("other"), "doc_id").write.options(**quoted).csv(f"{path}/b")
    raw.where(kind == 2).write.options(**quoted, sep="\t").csv(f"{path}/c")
    pages = raw.where(kind == 3).withColumn(ORD, F.col("doc_id").cast("long"))
    _pages(pages, ORD, "Data", ["doc_id", "text", "quality"]).withColumnRenamed("value", "payload").write.partitionBy(
        "page").text(f"{path}/d")
    return dictionaries.scan_dictionary(spark, path, ["doc_id", "text", "quality"], key="Data").drop(ORD)


def ingest_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files to a store and its report: a second place, renamed columns, a seeded and a failing registry."""
    landed, store, report = (fresh_path(spark, n) for n in ("landed", "store", "report"))
    quoted = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    R.allofus_hash_raw(spark, sf_dir).drop(ORD).write.options(**quoted).csv(f"{landed}/parts")
    R.table(spark, sf_dir, "region").select(F.lit("x").alias("itemid")).write.options(header=True).csv(f"{landed}/short")
    suppliers = R.table(spark, sf_dir, "supplier").select(
        F.lit("General").alias("category"), R.text("s_suppkey").alias("itemid"), F.col("s_name").alias("label"), R.text("s_nationkey").alias("fluid")
    )
    suppliers.unionByName(suppliers).write.options(**quoted).csv(f"{landed}/items")
    documents = R.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ORD), F.sha2("text", 256).alias("IndicatorCode"), F.col("text").alias("IndicatorName")
    )
    _pages(documents, ORD, "value", ["IndicatorCode", "IndicatorName"]).withColumnRenamed("value", "payload").write.partitionBy(
        "page").text(f"{landed}/texts")
    places = {
        "nih_allofus": Landing((f"{landed}/parts",), "csv"),
        "mimic_iv": Landing((f"{landed}/absent", f"{landed}/short", f"{landed}/items"), "csv", min_chars=fixed.MIN_PAYLOAD_CHARS),
        "who": Landing((f"{landed}/texts",), key="value"),
        "nhanes": Landing((f"{landed}/absent",)),
    }
    told = ingest_files(spark, places, HASH_SPECS, store, report, "first", [*places, "usaid"], buckets=8)
    stored = bucket_store.read_store(spark, store).groupBy("source").agg(
        F.count("*").alias("n_stored"), F.sum(F.length("document")).alias("chars")
    )
    names = spark.createDataFrame([(k, HASH_SPECS[k].source) for k in [*places, "usaid"]], "source_key string, source string")
    return told.join(names, "source_key").join(stored, "source", "left").select(
        "source_key", "status", "n_landed", "n_bad", "n_rows", "n_stored", "chars"
    )


def with_seed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents landed for some sources; nations stand in for the others."""
    landed = R.table(spark, sf_dir, "documents").select("source", "text")
    seed = R.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src"), R.text("n_nationkey")).alias("source"), F.col("n_name").alias("text")
    )
    return landing.with_seed_fallback(landed, seed)


def first_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three landings of the sources: good documents, toxic ones, all of them."""
    rows = R.labelled(spark, sf_dir)
    columns = ["source", "doc_id", F.col("text").alias("payload")]
    landings = [
        rows.where((F.col("quality") == 1) & (F.col("toxic") == 1)).select(*columns),
        rows.where(F.col("toxic") == 1).select(*columns),
        rows.select(*columns),
    ]
    chosen = landing.first_reachable(landings)
    return R.longs(chosen, "priority").select("source", "doc_id", "priority")


def scan_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "processed")
    sinks.write_parquet_overwrite(harmonise_unified(R.unified_landed(spark, sf_dir)), path)
    return stores.scan_processed(spark, path)


def write_parquet_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to one place: the second replaces the first."""
    path = fresh_path(spark, "overwritten")
    documents = R.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sinks.write_parquet_overwrite(documents.withColumn("text", F.lower("text")), path)
    sinks.write_parquet_overwrite(documents, path)
    return spark.read.parquet(path)


def scan_vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "store")
    sinks.ensure_store(spark, path)
    rows = R.store(spark, sf_dir).withColumn(ORD, F.col("id"))
    sinks.upsert_by_id(spark, path, rows)
    return stores.scan_vector_store(spark, path).select(
        "id", "source", "indicator_id", "short_name", "document",
        F.posexplode("vector").alias("position", "value"),
    ).select(
        "id", "source", "indicator_id", F.length("document").cast("bigint").alias("chars"),
        F.col("position").cast("bigint").alias("position"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


def scan_wide_measure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables of different tables: the scan merges their columns."""
    path = fresh_path(spark, "wide")
    wide = R.wide_rows(spark, sf_dir).drop(ORD)
    demo = F.col("table_id") == "DEMO_J"
    wide.where(demo).drop("c_acctbal").write.partitionBy("table_id").parquet(path)
    wide.where(~demo).write.mode("append").partitionBy("table_id").parquet(path)
    return stores.scan_wide_measure_table(spark, path).select(
        "table_id", "SEQN", "c_acctbal", "c_nationkey"
    )


def scan_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "observations")
    stores.write_observations(R.who_rows(spark, sf_dir).drop(ORD), path, buckets=8)
    return stores.scan_observations(spark, path).drop("observation_bucket", "n_buckets")


def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored by source, then labelled ones replaced, twice for good ones."""
    path = fresh_path(spark, "upserted")
    first, second = _landings(spark, sf_dir)
    sinks.upsert_by_id(spark, path, first)
    sinks.upsert_by_id(spark, path, second)
    return stores.scan_vector_store(spark, path).select("id", "source", "short_name", "document")


def _landings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents; then labelled ones with another text, good ones twice, and toxic ones under a new id."""
    documents = R.table(spark, sf_dir, "documents")

    def row(identifier, document, order):
        return [
            identifier.alias("id"), F.col("source"), R.text("doc_id").alias("indicator_id"),
            F.col("lang").alias("short_name"), document.alias("document"),
            F.array(F.col("n_chars").cast("float")).alias("vector"),
            F.create_map(F.lit("source"), F.col("source")).alias("metadata"), order.alias(ORD),
        ]

    key = F.concat(F.lit("doc_"), R.text("doc_id"))
    labelled = R.labelled(spark, sf_dir).where(F.col("quality").isNotNull())
    first = labelled.select(*row(key, F.lit("replaced"), F.col("doc_id")))
    again = labelled.where(F.col("quality") == 1).select(
        *row(key, F.concat(F.lit("again "), F.col("lang")), F.col("doc_id") + 1_000_000_000)
    )
    new = labelled.where(F.col("toxic") == 1).select(
        *row(F.concat(key, F.lit("_new")), F.lit("inserted"), F.col("doc_id"))
    )
    return documents.select(*row(key, F.col("text"), F.col("doc_id"))), first.unionByName(again).unionByName(new)


def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same landings in a versioned bucket store, the second one sent twice."""
    path = fresh_path(spark, "bucketed")
    first, second = _landings(spark, sf_dir)
    bucket_store.upsert(spark, path, first, "first", buckets=8)
    bucket_store.upsert(spark, path, second, "second")
    bucket_store.upsert(spark, path, second, "second")
    return bucket_store.read_store(spark, path).select("id", "source", "short_name", "document")


def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all labelled documents, toxic ones with an appended line, those that the store doesn't hold so."""
    path = fresh_path(spark, "bucketed")
    bucket_store.upsert(spark, path, _landings(spark, sf_dir)[0], "first", buckets=8)
    sent = R.labelled(spark, sf_dir).where(F.col("quality").isNotNull()).select(
        F.concat(F.lit("doc_"), R.text("doc_id")).alias("id"), "source",
        F.when(F.col("toxic") == 1, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")).alias("document"),
    )
    return bucket_store.changed_documents(spark, path, sent)


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonised rows written as CSV and read back."""
    path = fresh_path(spark, "export-csv")
    rows = harmonise(spark, R.hash_landed(spark, sf_dir), HASH_SPECS, ["mimic_iv", "uk_biobank"])
    sinks.export_csv(rows.select("id", "source", "document"), path)
    return spark.read.options(header=True, escape='"').csv(path)


def export_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dictionary rows with nulls written as JSON records and read back."""
    path = fresh_path(spark, "export-json")
    rows = R.usaid_raw(spark, sf_dir).drop(ORD)
    sinks.export_json_records(rows, path)
    return spark.read.schema(rows.schema).json(path)


QUERIES = {
    "scan_json_envelope": scan_json_envelope,
    "scan_csv": scan_csv,
    "scan_tsv": scan_tsv,
    "scan_ragged_text": scan_ragged_text,
    "scan_json_or_csv": scan_json_or_csv,
    "scan_dictionary": scan_dictionary,
    "ingest_landed": ingest_landed,
    "with_seed_fallback": with_seed_fallback,
    "first_reachable": first_reachable,
    "scan_processed": scan_processed,
    "write_parquet_overwrite": write_parquet_overwrite,
    "scan_vector_store": scan_vector_store,
    "scan_wide_measure_table": scan_wide_measure_table,
    "scan_observations": scan_observations,
    "upsert_by_id": upsert_by_id,
    "bucket_upsert": bucket_upsert,
    "changed_documents": changed_documents,
    "export_csv": export_csv,
    "export_json_records": export_json_records,
}

SQL = {
    "changed_documents": """
        SELECT 'doc_' || d.doc_id AS id, d.source, d.text || chr(10) || 'more' AS document
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND l.quality IS NOT NULL""",
    "scan_json_envelope": R.ctes("usaid_raw") + """
        SELECT IndicatorId, Label, Definition FROM usaid_raw""",
    "scan_csv": """
        SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text, CAST(l.quality AS VARCHAR) AS quality
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "scan_tsv": """
        SELECT CAST(p_partkey AS VARCHAR) AS concept_id, p_name AS concept_name,
               p_brand AS domain_id, p_type AS vocabulary_id
        FROM part""",
    "scan_ragged_text": """
        SELECT CAST(c_custkey AS VARCHAR) AS field_id, c_name AS title,
               CASE WHEN c_nationkey % 5 <> 1 THEN CAST(c_nationkey AS VARCHAR) END AS nation
        FROM customer WHERE c_nationkey % 5 <> 0""",
    "scan_json_or_csv": """
        SELECT CAST(doc_id AS VARCHAR) AS IndicatorCode, text AS IndicatorName FROM documents""",
    "with_seed_fallback": """
        SELECT source, text FROM documents
        UNION ALL
        SELECT 'src' || n_nationkey, n_name FROM nation
        WHERE 'src' || n_nationkey NOT IN (SELECT source FROM documents)""",
    "first_reachable": """
        WITH tagged AS (
            SELECT d.source, d.doc_id, d.text, 0 AS priority
            FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 1
            UNION ALL
            SELECT d.source, d.doc_id, d.text, 1
            FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1
            UNION ALL
            SELECT source, doc_id, text, 2 FROM documents),
        sized AS (SELECT source, doc_id, priority,
                         sum(length(text)) OVER (PARTITION BY source, priority) AS chars FROM tagged),
        best AS (SELECT source, doc_id, priority, min(priority) OVER (PARTITION BY source) AS lowest
                 FROM sized WHERE chars > 200)
        SELECT source, doc_id, CAST(priority AS BIGINT) AS priority FROM best WHERE priority = lowest""",
    "write_parquet_overwrite": "SELECT doc_id, source, text FROM documents",
    "scan_vector_store": R.ctes("store") + """
        SELECT id, source, indicator_id, length(document) AS chars,
               unnest(range(len(vector))) AS position,
               round(unnest(vector), 6) AS value
        FROM store""",
    "scan_wide_measure_table": """
        SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'DEMO_J' ELSE c_mktsegment END AS table_id,
               c_custkey AS SEQN,
               CASE WHEN c_acctbal > 0 AND c_mktsegment <> 'HOUSEHOLD' THEN c_acctbal END AS c_acctbal,
               CAST(c_nationkey AS DOUBLE) AS c_nationkey
        FROM customer""",
    "scan_observations": R.ctes("who_rows") + """
        SELECT variable_id, SpatialDim, TimeDim, NumericValue, Value FROM who_rows""",
    "upsert_by_id": """
        SELECT 'doc_' || d.doc_id AS id, d.source, d.lang AS short_name,
               CASE WHEN l.quality = 1 THEN 'again ' || d.lang
                    WHEN l.quality IS NOT NULL THEN 'replaced' ELSE d.text END AS document
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        UNION ALL
        SELECT 'doc_' || d.doc_id || '_new', d.source, d.lang, 'inserted'
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1""",
    "export_json_records": R.ctes("usaid_raw") + """
        SELECT IndicatorId, Label, ShortName, Definition FROM usaid_raw""",
}

SQL["scan_dictionary"] = SQL["scan_csv"]
SQL["bucket_upsert"] = SQL["upsert_by_id"]

_SEEDS = [HASH_SPECS["nhanes"].document.format(**row) for row in HASH_SPECS["nhanes"].seed]
SQL["ingest_landed"] = f"""
    WITH parts AS (SELECT count(*) AS n, CAST(sum(len('Source: NIH All of Us | Concept ID: ' || p_partkey || ' | Name: ' || p_name
            || ' | Domain: ' || p_brand || ' | Vocabulary: ' || p_type)) AS BIGINT) AS chars FROM part),
    items AS (SELECT count(*) AS n, CAST(sum(len('Source: MIMIC-IV | ItemID: ' || s_suppkey || ' | Label: ' || s_name
            || ' | Fluid: ' || s_nationkey || ' | Category: General')) AS BIGINT) AS chars FROM supplier),
    texts AS (SELECT count(*) AS n, CAST(sum(len('Source: WHO GHO | Indicator Code: ' || sha256(text) || ' | Name: ' || text)) AS BIGINT) AS chars
        FROM (SELECT DISTINCT text FROM documents))
    SELECT 'nih_allofus' AS source_key, 'ok' AS status, n AS n_landed, CAST(0 AS BIGINT) AS n_bad, n AS n_rows, n AS n_stored, chars FROM parts
    UNION ALL SELECT 'mimic_iv', 'ok', 2 * n, 0, n, n, chars FROM items
    UNION ALL SELECT 'who', 'ok', (SELECT count(*) FROM documents), 0, n, n, chars FROM texts
    UNION ALL SELECT 'nhanes', 'seeded', 0, 0, {len(_SEEDS)}, {len(_SEEDS)}, {sum(map(len, _SEEDS))}
    UNION ALL SELECT 'usaid', 'failed', 0, 0, 0, NULL, NULL"""
