"""Wide tables read by a catalogue: only files and columns that a target names are opened."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlex import fixed
from varlex.session import path_exists
from varlex.sources.dictionaries import _opened

CATALOGUE = "table_id string, file string, column string, type string"
# What numbers a column may hold; others are no measurements.
_TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType()}


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(table_id, file) below folders named ``table_id=...``, listed by the driver as any scan does."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for folder in system.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("table_id="):
            table = jvm.java.net.URLDecoder.decode(name[len("table_id=") :].replace("+", "%2B"), "UTF-8")
            for one in system.listStatus(folder.getPath()):
                if one.getPath().getName().endswith(".parquet"):
                    found.append((table, one.getPath().toString()))
    return sorted(found)


def write_catalogue(spark: SparkSession, path: str, catalogue: str) -> None:
    """(table_id, file, column, type) of all wide tables below ``path``; footers are read by the executors."""
    files = _files(spark, path)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, file in zip(batch.column("table_id").to_pylist(), batch.column("file").to_pylist()):
                system, place = _opened(file)
                with system.open_input_file(place) as stream:
                    schema = pq.ParquetFile(stream).schema_arrow
                rows += [(table, file, field.name, str(field.type)) for field in schema]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["table_id", "file", "column", "type"])

    listed = spark.createDataFrame(files, "table_id string, file string")
    tasks = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    listed.repartition(tasks).mapInArrow(footers, CATALOGUE).write.mode("overwrite").parquet(catalogue)


def read_catalogue(spark: SparkSession, catalogue: str) -> DataFrame:
    if not path_exists(spark, catalogue):
        raise FileNotFoundError(f"no catalogue at {catalogue}; write one first")
    return spark.read.schema(CATALOGUE).parquet(catalogue)


def scan_targets(
    spark: SparkSession, catalogue: DataFrame, targets: DataFrame, table: str = "wide_table", variable: str = "variable_id",
    key: str = fixed.WIDE_KEY,
) -> DataFrame:
    """(table_id, variable_id, key, value) of the variables that targets name in their tables.

    Targets meet the catalogue, never the tables: files without a named column
    aren't opened, and of the others only the key and the named columns are
    read.  What comes to the driver are files and columns, as in any scan.
    Rows without key or value are dropped; values are doubles.  Files that
    write a column with different types are read in groups of equal types.
    """
    wanted = targets.select(F.col(table).alias("table_id"), F.col(variable).alias("column")).distinct()
    keys = catalogue.where(F.col("column") == key).select("file", F.col("type").alias("key_type"))
    known = catalogue.where((F.col("column") != key) & F.col("type").isin(*_TYPES)).join(wanted, ["table_id", "column"], "left_semi")
    per_file = known.join(keys, "file").groupBy("table_id", "file", "key_type").agg(
        F.array_sort(F.collect_list(F.struct("column", "type"))).alias("columns")
    )
    groups = per_file.groupBy("table_id", "key_type", "columns").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    frames = []
    for group in sorted(groups, key=lambda g: (g["table_id"], g["files"])):
        fields = [T.StructField(c["column"], _TYPES[c["type"]]) for c in group["columns"]]
        schema = T.StructType([T.StructField(key, _TYPES[group["key_type"]]), *fields])
        names = [f.name for f in fields]
        rows = spark.read.schema(schema).parquet(*group["files"])
        typed = rows.select(F.lit(group["table_id"]).alias("table_id"), F.col(key).cast("long").alias(key), *[
            F.col(f"`{n}`").try_cast("double").alias(n) for n in names
        ])
        long = typed.unpivot(["table_id", key], names, "variable_id", "value")
        frames.append(long.where(F.col(key).isNotNull() & F.col("value").isNotNull()))
    if not frames:
        return spark.createDataFrame([], f"table_id string, variable_id string, {key} long, value double")
    return reduce(lambda a, b: a.unionByName(b), frames).select("table_id", "variable_id", key, "value")
