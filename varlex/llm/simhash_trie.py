"""SimHash near-duplicates: links between fingerprints by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import documents, durable, forget_others, inputs, maybe_among, split_groups
from varlex.llm.components import connected_components

SHINGLE_WORDS = 4
ERROR_BUDGET = 4
SEED = 42
# Six blocks of bits: with at most four errors two of them are free of errors.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
# Fingerprints below one pair of blocks that one task joins at a time.
GROUP_ROWS = 4096
# Node pairs that are split at a time.
FRONTIER = 1 << 18


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a whole UTF-8 text, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle_words] + 1))
    digest, seed = xxhash.xxh64_intdigest, SEED
    total, counts = len(starts), np.zeros(64, np.int64)
    first, last = starts.tolist(), ends[shingle_words - 1 :].tolist()
    for k in range(0, total, 1 << 16):
        hashes = np.array(
            [digest(joined[s:e], seed) for s, e in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)])], np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            found = np.array([fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"]
            )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


def trie_pairs(
    fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = ERROR_BUDGET
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one group that differ in at most ``budget`` bits.

    ``fps`` (uint64) is sorted and free of repeats inside each group
    [start, end).  A trie node is a range of fingerprints that share their
    leading bits.  Pairs of nodes go down together, one bit at a time; two
    children on different sides add one differing bit, and a pair beyond the
    budget is dropped with everything below it.  Two single fingerprints are
    compared at once.  At most ``FRONTIER`` pairs are split at a time, depth
    first, so memory stays bounded.
    """
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in ones:
            bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        return high - (ones[depth][high] - ones[depth][low])

    several = ends - starts > 1
    a0, a1 = starts[several].astype(np.int64), ends[several].astype(np.int64)
    stack = [(0, a0, a1, a0, a1, np.zeros(len(a0), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > FRONTIER:
            for k in range(0, len(a0), FRONTIER):
                part = slice(k, k + FRONTIER)
                stack.append((depth, a0[part], a1[part], b0[part], b1[part], errors[part]))
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            if near.any():
                yield i[near], j[near]
            rest = ~single
            a0, a1, b0, b1, errors = a0[rest], a1[rest], b0[rest], b1[rest], errors[rest]
        if not len(a0) or depth == 64:
            continue
        am, bm = split(depth, a0, a1), split(depth, b0, b1)
        same = a0 == b0
        crossing = errors < budget
        across = crossing & ~same
        kinds = (
            (a0, am, b0, bm, errors, None),
            (am, a1, bm, b1, errors, None),
            (a0, am, bm, b1, errors + 1, crossing),
            (am, a1, b0, bm, errors + 1, across),
        )
        parts = []
        for c0, c1, d0, d1, e, allowed in kinds:
            keep = (c1 > c0) & (d1 > d0) & ~((c0 == d0) & (c1 - c0 == 1))
            if allowed is not None:
                keep &= allowed
            parts.append((c0[keep], c1[keep], d0[keep], d1[keep], e[keep]))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def spanning(size: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each index over all pairs; every pair is used, none is kept."""
    label = np.arange(size)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups of one task; rows arrive sorted by group and fingerprint."""
    names = ["a", "b"]

    def links(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(group)]))
        label = spanning(len(fps), trie_pairs(fps, starts, ends))
        linked = np.flatnonzero(label != np.arange(len(fps)))
        left, right = fps[linked].view(np.int64), fps[label[linked]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names)

    group, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        more = np.asarray(batch.column("bucket"))
        group = np.concatenate((group, more))
        fps = np.concatenate((fps, np.asarray(batch.column("fp")).view(np.uint64)))
        whole = np.searchsorted(group, group[-1], "left") if len(group) else 0
        if whole > 50_000:
            yield links(group[:whole], fps[:whole])
            group, fps = group[whole:], fps[whole:]
    if len(group):
        yield links(group, fps)


def fingerprint_links(distinct: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the error budget.

    ``distinct`` has one row per fingerprint (column fp).  Two fingerprints
    with at most four different bits agree on two of six blocks, so each
    fingerprint meets the others only below the (15) pairs of blocks it holds,
    where a trie self-join finds the pairs.  A pair of blocks that more than
    ``group_rows`` fingerprints share is dealt out over several groups.
    """
    bits = [F.shiftrightunsigned("fp", 64 - at - n).bitwiseAND((1 << n) - 1) for at, n in BLOCKS]
    keys = [
        F.lit(k << 22).bitwiseOR(F.shiftleft(bits[i], 11)).bitwiseOR(bits[j])
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("blocks"))
    groups = split_groups(rows, "blocks", "fp", group_rows)
    # As unsigned numbers: those with the highest bit come last.
    ordered = groups.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", F.col("fp") < 0, "fp")
    return ordered.mapInArrow(_joined, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at four or fewer different bits; ``component_id`` is the
    smallest doc_id that links reach, the own one included.  Null, empty and
    blank texts have fingerprint zero, which links like any other.  Texts of
    any length are read whole.  Equal texts and repeated rows share their
    fingerprint and so their component; a null doc_id stays null, is never a
    component_id, and a component of nothing else has a null component_id.
    Other columns are not read.  An empty table gives an empty result.
    """
    marked = durable(fingerprints(inputs(docs, doc_id=doc_id, text=text)))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = durable(rooted.join(lowest, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, with all its columns.

    It is the row with the smallest doc_id of its component (null last), then
    with the smallest text hash; of rows that are equal in both any one.  Only
    rows that may have to go are shuffled with their texts.
    """
    prefix = "_s"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names = [f"{prefix}_id", f"{prefix}_hash"]
    rows = docs.select(
        "*", F.col(f"`{doc_id}`").cast("long").alias(names[0]), F.xxhash64(F.col(f"`{text}`")).alias(names[1])
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(found.view(np.int64))], [*names, "fp"]
            )

    marked = durable(
        rows.select(*names, F.col(f"`{text}`").cast("binary").alias("text"))
        .mapInArrow(scan, ", ".join(f"{n} long" for n in names) + ", fp long")
        .groupBy(*names, "fp").agg(F.count("*").alias("times"))
    )
    # The row that stays for each fingerprint, then for each component.
    best = F.min(F.struct(F.col(names[0]).isNull().alias("none"), *names))
    distinct = durable(marked.groupBy("fp").agg(best.alias("best")))
    linked = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = durable(
        distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "best", F.coalesce("component", "fp").alias("root"))
    )
    kept = rooted.groupBy("root").agg(F.min("best").alias("kept"))
    judged = marked.join(rooted.select("fp", "root").join(kept, "root"), "fp")
    same = F.struct(*names).eqNullSafe(F.struct(*[F.col(f"kept.{n}") for n in names]))
    touched = durable(judged.withColumn("stays", same).where("not stays or times > 1").select(*names, "stays"))
    possible, rest = maybe_among(rows, touched.select(names[0]), names[0])
    other = touched.select(*[F.col(n).alias(f"{n}_t") for n in names], F.col("stays").alias(f"{prefix}_stays"))
    matches = F.lit(True)
    for n in names:
        matches &= F.col(n).eqNullSafe(F.col(f"{n}_t"))
    found = possible.join(other, matches, "left")
    alone = found.where(F.col(f"{prefix}_stays").isNull())
    repeated = found.where(F.col(f"{prefix}_stays")).dropDuplicates(names)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*columns).unionByName(alone.select(*columns)).unionByName(repeated.select(*columns))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
