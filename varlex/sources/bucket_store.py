"""A store of immutable bucket versions: snapshots, conflicts and replays without a database.

Layout below one folder::

    data/<version>/s=<source>/b=<bucket>/   rows, never changed once written
    manifests/<number>.json                 which version of each bucket is current
    ledger/<digest of a batch id>           which batches are in

A source has a number in the manifest; a row's bucket is a hash of its id.  An
upsert writes new versions of the buckets it touches and then creates the next
manifest.  Creating it fails if another writer has created it, so one of two
writers gets a ``StoreConflict`` and has changed nothing.  A reader keeps the
manifest it started with.  A batch that was applied is not applied again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlex.operators.embed import EncoderFactory, add_hash_vector, dealt_for_vectors, model_embed
from varlex.operators.ordering import ORD, dedup_keep_last
from varlex.session import discard, fresh_path
from varlex.sources.stores import STORE_SCHEMA

BUCKETS = 64
DIGEST = "document_digest"
SCHEMA = T.StructType([*STORE_SCHEMA, T.StructField(DIGEST, T.StringType())])
_FOLDERS = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("b", T.IntegerType())])


class StoreConflict(RuntimeError):
    """Another writer committed first; read the store again and repeat the batch."""


@dataclass
class Manifest:
    """One snapshot: for each (source number, bucket) its version and rows."""

    number: int = -1
    buckets: int = BUCKETS
    sources: list[str | None] = field(default_factory=list)
    parts: dict[tuple[int, int], tuple[str, int]] = field(default_factory=dict)
    batch: str | None = None

    def written(self) -> str:
        listed = [[s, b, version, rows] for (s, b), (version, rows) in sorted(self.parts.items())]
        return json.dumps({"number": self.number, "buckets": self.buckets, "sources": self.sources, "parts": listed, "batch": self.batch})

    @staticmethod
    def read(text: str) -> Manifest:
        found = json.loads(text)
        parts = {(s, b): (version, rows) for s, b, version, rows in found["parts"]}
        return Manifest(found["number"], found["buckets"], found["sources"], parts, found["batch"])


class _Folder:
    """Small files in the store's file system, by Hadoop's own client."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        where = self._path(name)
        if not self.fs.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where))

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one already."""
        where = self._path(name)
        try:
            stream = self.fs.create(where, False)
        except Exception:
            if self.fs.exists(where):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _name(number: int) -> str:
    return f"manifests/{number:020d}.json"


def _mark(batch: str) -> str:
    return f"ledger/{hashlib.sha256(batch.encode()).hexdigest()}"


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest:
    """The newest snapshot, or that of a number; an absent store is an empty one."""
    folder = _Folder(spark, path)
    if number is None:
        names = folder.names("manifests")
        return Manifest.read(folder.text(f"manifests/{names[-1]}")) if names else Manifest()
    return Manifest.read(folder.text(_name(number)))


def _bucket(buckets: int, column: str = "id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _numbered(rows: DataFrame, sources: list[str | None]) -> DataFrame:
    """``rows`` with the number ``s`` of their source: a join with the manifest's list of sources."""
    listed = rows.sparkSession.createDataFrame([(k, name) for k, name in enumerate(sources)], "s int, _source string")
    return rows.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _parts(spark: SparkSession, path: str, snapshot: Manifest, wanted: list[tuple[int, int]]) -> DataFrame:
    """Rows of the wanted buckets as the snapshot has them, with ``s`` and ``b``."""
    folders = [f"{path}/data/{snapshot.parts[p][0]}/s={p[0]}/b={p[1]}" for p in wanted if p in snapshot.parts]
    if not folders:
        return spark.createDataFrame([], T.StructType([*SCHEMA, *_FOLDERS]))
    # Versions are folders above the partition columns, so the columns come from the files' places.
    rows = spark.read.schema(SCHEMA).parquet(*folders)
    place = F.col("_metadata.file_path")
    return rows.select(
        *SCHEMA.names, F.regexp_extract(place, r"/s=(\d+)/b=\d+/[^/]*$", 1).cast("int").alias("s"),
        F.regexp_extract(place, r"/b=(\d+)/[^/]*$", 1).cast("int").alias("b"),
    )


def read_store(spark: SparkSession, path: str, sources: list[str | None] | None = None, number: int | None = None) -> DataFrame:
    """Store rows of the newest snapshot (or that of a number); with ``sources`` only their buckets are opened."""
    snapshot = manifest(spark, path, number)
    chosen = [p for p in sorted(snapshot.parts) if sources is None or snapshot.sources[p[0]] in sources]
    folders = [f"{path}/data/{snapshot.parts[p][0]}/s={p[0]}/b={p[1]}" for p in chosen]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*folders)


def _touched(updates: DataFrame) -> list[tuple[int, int]]:
    """(source, bucket) of the updates; there are no more of them than the store has buckets."""
    return sorted((r["s"], r["b"]) for r in updates.select("s", "b").distinct().collect())


def upsert(
    spark: SparkSession, path: str, updates: DataFrame, batch: str, order: Column | str = ORD,
    buckets: int = BUCKETS, based_on: int | None = None, encode: Callable[[DataFrame], DataFrame] | None = None,
) -> Manifest:
    """Replace or insert whole rows by id, as one commit; the last row of an id in ``order`` wins.

    ``batch`` names the batch: one that is in the store already changes
    nothing.  ``buckets`` counts for a new store.  ``based_on`` is the number
    of the snapshot the batch was made for; if another one is newest by then,
    or at the commit, that is a ``StoreConflict``.  An id belongs to one
    source, as it carries its prefix.  Only the touched buckets are read and
    written; a bucket is as large as its share of a source, so a hot source
    has as many tasks as buckets.  With ``encode`` the updates are a stored
    table without vectors and with every id once, in any order; they get their
    vectors behind the shuffle, in the tasks that write them.
    """
    folder = _Folder(spark, path)
    snapshot = manifest(spark, path)
    if snapshot.batch is not None:
        # A writer that was lost between its commit and its mark.
        folder.create(_mark(snapshot.batch), str(snapshot.number))
    if folder.exists(_mark(batch)):
        return snapshot
    if based_on is not None and based_on != snapshot.number:
        raise StoreConflict(f"the batch is for snapshot {based_on}, the store is at {snapshot.number}")
    buckets = snapshot.buckets if snapshot.number >= 0 else buckets
    names = [r["source"] for r in updates.select("source").distinct().collect()]
    sources = snapshot.sources + sorted((n for n in names if n not in snapshot.sources), key=lambda n: (n is None, n))
    columns = [F.col(c).cast(SCHEMA[c].dataType).alias(c) for c in STORE_SCHEMA.names if not encode or c != "vector"]
    latest = updates if encode else dedup_keep_last(updates, ["id"], order)
    latest = latest.select(*columns, F.sha2("document", 256).alias(DIGEST))
    placed = _numbered(latest, sources).withColumn("b", _bucket(buckets))
    touched = _touched(_numbered(updates.select("id", "source"), sources).withColumn("b", _bucket(buckets)))
    version = uuid.uuid4().hex
    target = f"{path}/data/{version}"
    stored = _parts(spark, path, snapshot, touched)
    kept = stored.join(placed.select("id"), "id", "left_anti").select(*SCHEMA.names, "s", "b")
    if encode:
        fresh = encode(dealt_for_vectors(placed, "s", "b")).withColumn("vector", F.col("vector").cast(SCHEMA["vector"].dataType))
        merged = kept.hint("rebalance", "s", "b").unionByName(fresh.select(*SCHEMA.names, "s", "b"))
    else:
        merged = kept.unionByName(placed.select(*SCHEMA.names, "s", "b")).hint("rebalance", "s", "b")
    merged.write.partitionBy("s", "b").parquet(target)
    sizes = (
        {(r["s"], r["b"]): r["count"] for r in spark.read.parquet(target).groupBy("s", "b").count().collect()} if touched else {}
    )
    following = Manifest(
        snapshot.number + 1, buckets, sources, snapshot.parts | {p: (version, n) for p, n in sizes.items()}, batch
    )
    if not folder.create(_name(following.number), following.written()):
        folder.remove(f"data/{version}")
        raise StoreConflict(f"snapshot {following.number} was committed by another writer")
    folder.create(_mark(batch), str(following.number))
    return following


def changed_documents(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows that are new or whose document differs from the stored one.

    Stored digests are compared: of the store only ids and digests of the
    touched buckets are read, never documents.
    """
    snapshot = manifest(spark, path)
    if snapshot.number < 0:
        return rows
    known = _numbered(rows.select("id", "source"), snapshot.sources).withColumn("b", _bucket(snapshot.buckets))
    stored = _parts(spark, path, snapshot, _touched(known)).select("id", F.col(DIGEST).alias("_digest"))
    return rows.withColumn("_digest", F.sha2("document", 256)).join(stored, ["id", "_digest"], "left_anti").drop("_digest")


def embed_batch(
    spark: SparkSession, rows: DataFrame, path: str, batch: str, encoder: EncoderFactory | None = None, buckets: int = BUCKETS,
    unique: bool = False,
) -> Manifest:
    """Embed the new and changed documents of a batch and upsert them as one commit.

    The last row of an id in ``_ord`` is compared with the store and staged in
    the shared folder without its vector, which the upsert adds as it writes.
    ``unique`` says that every id comes once, so that none need be looked for.
    """
    latest = rows if unique else dedup_keep_last(rows, ["id"])
    changed = changed_documents(spark, path, latest.drop(ORD))

    def encode(some: DataFrame) -> DataFrame:
        return add_hash_vector(some) if encoder is None else model_embed(some, encoder)

    staged = fresh_path(spark, "changed")
    try:
        changed.write.option("compression", "zstd").parquet(staged)
        return upsert(spark, path, spark.read.parquet(staged), batch, buckets=buckets, encode=encode)
    finally:
        discard(spark, staged)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(number, batch, parts, rows, written) of all snapshots; ``written`` counts the buckets a commit replaced."""
    before: dict = {}
    lines = []
    for name in _Folder(spark, path).names("manifests"):
        one = manifest(spark, path, int(name.split(".")[0]))
        fresh = sum(before.get(p) != v for p, v in one.parts.items())
        lines.append((one.number, one.batch, len(one.parts), sum(n for _, n in one.parts.values()), fresh))
        before = one.parts
    return spark.createDataFrame(lines, "number long, batch string, parts long, rows long, written long")


def expire(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Forget all but the last ``keep`` snapshots and remove versions that none of these has; returns how many went.

    Versions of commits that are under way have no manifest yet: run it while
    nobody writes.
    """
    folder = _Folder(spark, path)
    names = folder.names("manifests")
    kept = {v for name in names[-keep:] for v, _ in Manifest.read(folder.text(f"manifests/{name}")).parts.values()}
    for name in names[:-keep]:
        folder.remove(f"manifests/{name}")
    gone = [v for v in folder.names("data") if v not in kept]
    for version in gone:
        folder.remove(f"data/{version}")
    return len(gone)
