"""Landed dictionaries of any format as a Spark data source: ``spark.read.format("dictionary")``.

Planning only lists the folder.  Each file, or byte range of a large one, is a
partition whose task settles format and header by itself and maps values to
columns by name, so files of one folder may differ in both.  Files are reached
through Arrow's file systems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varlex import fixed
from varlex.operators.ordering import ORD

FORMATS = ("auto", "json", "csv", "tsv", "ragged")
RANGE_BYTES = 128 << 20
BATCH_ROWS = 8_192
PROBLEM = "_problem"
_ORDER = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("item", T.LongType()),
])


class FileRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file; a whole file if ``end`` is its size and ``start`` 0."""

    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it; local names are taken as they are."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _lines(stream, start: int, end: int) -> Iterator[str]:
    """The lines that start inside a byte range."""
    stream.seek(max(0, start - 1))
    if start:
        stream.readline()  # the rest of a line that belongs to the range before
    while stream.tell() < end:
        line = stream.readline()
        if not line:
            return
        yield line.decode("utf-8", "replace")


class DictionaryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.columns = json.loads(options["columns"])
        self.key, self.format = options.get("key") or None, options.get("as", "auto")
        self.range_bytes, self.in_ranges = int(options.get("rangebytes", RANGE_BYTES)), options.get("inranges") == "true"
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}, not {self.format!r}")

    def partitions(self) -> Sequence[InputPartition]:
        found: list[FileRange] = []
        for path in self.paths:
            system, place = _opened(path)
            info = system.get_file_info(place)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            infos = [info] if info.is_file else system.get_file_info(pafs.FileSelector(place, recursive=True))
            scheme = path.split(place)[0] if "://" in path and not path.startswith("file:") else ""
            for one in sorted((i for i in infos if i.is_file), key=lambda i: i.path):
                parts = one.path[len(place) :].split("/") if not info.is_file else []
                if one.size and not any(p.startswith(("_", ".")) for p in parts):
                    # Only files whose records are lines can be cut.
                    step = self.range_bytes if self.in_ranges and self.format in ("csv", "tsv", "ragged") else one.size
                    found += [FileRange(scheme + one.path, s, min(s + step, one.size), one.size) for s in range(0, one.size, step)]
        return found or [FileRange("", 0, 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("item", pa.int64())])
        schema = pa.schema([*((c, pa.string()) for c in self.columns), (ORD, kind), (PROBLEM, pa.string())])
        held: list[dict] = []
        if not partition.path:
            return
        for number, (row, problem) in enumerate(self._rows(partition)):
            place = {"file": partition.path, "block": partition.start, "seq": number, "item": 0}
            held.append({**{c: row.get(c) for c in self.columns}, ORD: place, PROBLEM: problem})
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    def _rows(self, part: FileRange) -> Iterator[tuple[dict, str | None]]:
        system, place = _opened(part.path)
        with io.BufferedReader(system.open_input_file(place)) as stream:
            if part.start or part.end < part.size:
                first = stream.readline().decode("utf-8-sig", "replace")
                body = _lines(stream, part.start, part.end)
                if not part.start:
                    next(body, None)
                yield from self._delimited(self.format, first, body)
                return
            head = stream.read(min(part.size, 4096)).decode("utf-8-sig", "replace").lstrip()
            stream.seek(0)
            if self.format == "json" or (self.format == "auto" and head[:1] in ("{", "[")):
                text = stream.read().decode("utf-8-sig", "replace")
                try:
                    payload = json.loads(text, parse_float=str, parse_int=str)
                except ValueError:
                    if self.format == "json":
                        yield {}, "not JSON"
                        return
                    yield from self._table("csv", io.StringIO(text, newline=""))
                    return
                yield from self._listed(payload)
                return
            text = io.TextIOWrapper(stream, "utf-8-sig", "replace", newline="")
            line = head.split("\n", 1)[0]
            guessed = "tsv" if "\t" in line and "," not in line else "csv"
            yield from self._table(guessed if self.format == "auto" else self.format, text)

    def _listed(self, payload) -> Iterator[tuple[dict, str | None]]:
        """Rows under the key, or of a list, or the payload itself."""
        if isinstance(payload, dict):
            listed = payload.get(self.key) if self.key else None
            payload = listed if isinstance(listed, list) else [payload]
        for row in payload if isinstance(payload, list) else [payload]:
            if not isinstance(row, dict):
                yield {}, "not an object"
                continue
            yield {c: self._text(row.get(c)) for c in self.columns}, None

    @staticmethod
    def _text(value) -> str | None:
        if value is None or isinstance(value, str):
            return value
        return str(value).lower() if isinstance(value, bool) else json.dumps(value, ensure_ascii=False)

    def _table(self, kind: str, text) -> Iterator[tuple[dict, str | None]]:
        if kind == "ragged":
            first = next(text, "")
            yield from self._delimited(kind, first, text)
            return
        records = csv.reader(text, delimiter="\t" if kind == "tsv" else ",", doublequote=True)
        csv.field_size_limit(1 << 30)
        yield from self._mapped(next(records, []), records)

    def _delimited(self, kind: str, first: str, lines: Iterator[str]) -> Iterator[tuple[dict, str | None]]:
        if kind == "ragged":
            cut = re.compile(fixed.RAGGED_DELIMITER)
            stripped = (line.rstrip("\r\n") for line in lines)
            yield from self._mapped(cut.split(first.rstrip("\r\n")), (cut.split(line) for line in stripped if line))
            return
        sep = "\t" if kind == "tsv" else ","
        yield from self._mapped(next(csv.reader([first], delimiter=sep), []), csv.reader(lines, delimiter=sep))

    def _mapped(self, header: list[str], records) -> Iterator[tuple[dict, str | None]]:
        """Values by the names of the file's own header; "no value" markers become null."""
        at = {name: k for k, name in reversed(list(enumerate(header)))}
        wanted = [(c, at[c]) for c in self.columns if c in at]
        if not wanted:
            yield {}, "no known column in the header"
            return
        for record in records:
            if not record:
                continue
            if len(record) > len(header):
                yield {}, "more fields than the header"
                continue
            yield {
                c: record[k] if k < len(record) and record[k] not in fixed.NA_TOKENS else None for c, k in wanted
            }, None


class DictionarySource(DataSource):
    """Options: paths and columns (JSON lists), as (a format), key, rangeBytes, inRanges."""

    @classmethod
    def name(cls) -> str:
        return "dictionary"

    def schema(self) -> T.StructType:
        columns = json.loads(self.options["columns"])
        return T.StructType([
            *(T.StructField(c, T.StringType()) for c in columns), T.StructField(ORD, _ORDER), T.StructField(PROBLEM, T.StringType()),
        ])

    def reader(self, schema: T.StructType) -> DictionaryReader:
        return DictionaryReader(dict(self.options))


def read_dictionary(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], fmt: str = "auto", key: str | None = None,
    range_bytes: int = RANGE_BYTES, one_line_records: bool = False,
) -> DataFrame:
    """Rows and problems of landed files: the columns as text, ``_ord``, and ``_problem`` for what isn't a row.

    ``fmt`` "auto" takes a file for JSON if it parses as such, else for a
    table with a header, cut at tabs if its header has tabs and no comma.
    JSON rows are those under ``key``, or of a list, or the payload.  Columns
    a file lacks are null.  With ``one_line_records`` files of a given table
    format are read in byte ranges; otherwise a file is one task, as quoted
    fields may hold line ends.  No job runs before the rows are asked for.
    """
    spark.dataSource.register(DictionarySource)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("dictionary").options(
        paths=json.dumps(paths), columns=json.dumps(list(columns)), key=key or "", rangeBytes=str(range_bytes),
        inRanges="true" if one_line_records else "false", **{"as": fmt},
    ).load()


def scan_dictionary(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], **options) -> DataFrame:
    """The rows alone, with their order in ``_ord``."""
    return read_dictionary(spark, path, columns, **options).where(F.col(PROBLEM).isNull()).drop(PROBLEM)


def bad_rows(read: DataFrame) -> DataFrame:
    """(file, problem, rows): what ``read_dictionary`` couldn't take for rows, by file."""
    return read.where(F.col(PROBLEM).isNotNull()).groupBy(
        F.col(f"{ORD}.file").alias("file"), F.col(PROBLEM).alias("problem")
    ).agg(F.count("*").alias("rows"))
