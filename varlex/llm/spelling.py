"""Spelling variants: pairs of trie nodes around a skipped position name exactly the words one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import chunked_matches, documents, durable, inputs

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
# One occurrence in so many (by hash) loses a code point.
TYPO_EVERY = 199
# Different words that a task counts before it hands them on.
HELD_WORDS = 400_000


def word_counts(
    docs: DataFrame, least_chars: int = LEAST_CHARS, typo_every: int | None = TYPO_EVERY, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(word, n): occurrences of each word of at least ``least_chars`` code points in all texts.

    Words are maximal runs of Latin letters, A-Z lower-cased.  With
    ``typo_every`` the runs of a document whose crc32 with the doc_id (null:
    empty) it divides lose the code point that the hash names.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return found

        for batch in batches:
            for name, whole in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not whole:
                    continue
                runs: Counter[str] = Counter()
                for found in chunked_matches(RUN, whole.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                    runs.update(found)
                if typo_every is not None:
                    start = zlib.crc32(f"{'' if name is None else name}:".encode())
                    hit = [r for r in runs if zlib.crc32(r.encode(), start) % typo_every == 0]
                    for run, n in [(r, runs.pop(r)) for r in hit]:
                        gone = zlib.crc32(run.encode(), start) % len(run)
                        held[run[:gone] + run[gone + 1 :]] += n
                held.update(runs)
                if len(held) > HELD_WORDS:
                    yield handed()
        if held:
            yield handed()

    rows = inputs(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = rows.mapInArrow(scan, "word string, n long").where(F.length("word") >= least_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def shared_start(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    return low


class TriePart:
    """Numbers the nodes of a trie whose words arrive in ascending order.

    A node is numbered when its first word arrives; the path to the last word
    is all that is kept.  ``path[i]`` is the node of the first i code points,
    the root is 0.  A part that starts with the path that it shares with the
    part before it gives the numbers one trie over all parts would.
    """

    def __init__(self, before: str = "", path: list[int] = (0,), following: int = 1):
        self.last, self.path, self.following = before, list(path), following

    def add(self, word: str) -> list[int]:
        shared = shared_start(self.last, word)
        del self.path[shared + 1 :]
        fresh = len(word) - shared
        self.path += range(self.following, self.following + fresh)
        self.following += fresh
        self.last = word
        return self.path


def _joined(parts: list[tuple[int, str, str, int, list[int]]]) -> dict[int, tuple[str, list[int], int]]:
    """For each part what its trie starts with, from (part, first, last, nodes, path to the last) in order.

    The numbers in ``parts`` are those of a part numbered by itself.
    """
    starts: dict[int, tuple[str, list[int], int]] = {}
    before, path, following = "", [0], 1
    for number, first, last, nodes, own in parts:
        starts[number] = (before, path, following)
        shared = shared_start(before, first)
        along = shared_start(first, last)
        # Alone, the path to the first word was numbered 1, 2, ...; of it the shared start is known already.
        path = [
            path[depth] if depth <= min(shared, along) else node + following - shared - 1
            for depth, node in enumerate(own)
        ]
        following += nodes - shared
        before = last
    return starts


def numbered_tries(words: DataFrame, backwards: bool = False) -> DataFrame:
    """(word, nodes): trie nodes of the 0, 1, ... first code points of each word, or of its last ones.

    The words (distinct) are sorted over range partitions, each of which is
    one part of the trie.  The driver joins the parts from the first and last
    word of each partition, so what it holds grows with partitions alone.
    """
    key = F.reverse("word") if backwards else F.col("word")
    ordered = durable(words.select("word", key.alias("way")).repartitionByRange("way").sortWithinPartitions("way"))

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TriePart(), None
        for batch in batches:
            for way in batch.column("way").to_pylist():
                first = way if first is None else first
                part.add(way)
        if first is not None:
            yield pa.RecordBatch.from_pylist([{
                "part": TaskContext.get().partitionId(), "first": first, "last": part.last,
                "nodes": part.following - 1, "path": part.path,
            }], pa.schema({
                "part": pa.int32(), "first": pa.string(), "last": pa.string(), "nodes": pa.int64(),
                "path": pa.list_(pa.int64()),
            }))

    summary = ordered.mapInArrow(ends, "part int, first string, last string, nodes long, path array<long>")
    starts = _joined(sorted(tuple(r) for r in summary.collect()))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            part = part or TriePart(*starts[TaskContext.get().partitionId()])
            ways = batch.column("way").to_pylist()
            nodes = [np.array(part.add(way), np.int64) for way in ways]
            stops = np.cumsum([0, *map(len, nodes)]).astype(np.int32)
            flat = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))], ["word", "nodes"]
            )

    return ordered.mapInArrow(number, "word string, nodes array<long>")


def node_pairs(counted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words with ids in code-point order, and their (left, right) node pairs around positions.

    ``skipped`` has a pair for every position of a word left out, ``whole``
    one for every place between two code points (and both ends).  Equal pairs
    mean equal strings: two words that share a skipped pair differ in the
    code point there, and a word whose skipped pair is another's whole pair
    has one code point more.  In a run of equal code points only the first
    skipped one counts as ``first``, as the others leave the same string.
    """
    forward = numbered_tries(counted.select("word")).withColumnRenamed("nodes", "fore")
    backward = numbered_tries(counted.select("word"), backwards=True).withColumnRenamed("nodes", "back")
    words = durable(
        counted.join(forward, "word").join(backward, "word")
        .select("word", "n", "fore", "back").sort("word").withColumn("id", F.monotonically_increasing_id())
    )
    spots = words.select("id", "n", "word", "fore", "back", F.posexplode("fore").alias("at", "left")).select(
        "id", "n", "word", "at", "left",
        F.get("back", F.size("back") - 1 - F.col("at")).alias("right"),
        F.get("back", F.size("back") - 2 - F.col("at")).alias("beyond"),
    )
    here, last = F.substring("word", F.col("at") + 1, F.lit(1)), F.substring("word", F.col("at"), F.lit(1))
    skipped = spots.where("beyond is not null").select(
        "left", F.col("beyond").alias("right"), "id", "n", ((F.col("at") == 0) | (here != last)).alias("first")
    )
    return words.select("id", "word", "n"), skipped, spots.select("left", "right", "id", "n")


def near_words(skipped: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, other, n, other_n) of all words exactly one edit apart, both ways round.

    A pair of nodes fixes all but one code point, so no more words than the
    alphabet has letters (90) share one, however the words are distributed.
    """
    a, b = skipped.alias("a"), skipped.alias("b")
    same = (F.col("a.left") == F.col("b.left")) & (F.col("a.right") == F.col("b.right"))
    replaced = a.join(b, same & (F.col("a.id") != F.col("b.id"))).select(
        F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("other_n")
    )
    shorter = skipped.where("first").alias("a").join(whole.alias("b"), same).select(
        F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("other_n")
    )
    longer = shorter.select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("other_n").alias("n"), F.col("n").alias("other_n"))
    return replaced.unionByName(shorter).unionByName(longer)


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root): where the chain of (id, form) ends.

    Every round doubles the length of the steps; forms are at least five times
    as frequent as their words, so a chain is no longer than a logarithm of
    the largest count, and the rounds grow with its logarithm.
    """
    steps = durable(forms.select("id", F.col("form").alias("root")))
    while True:
        following = steps.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = steps.join(following, "root")
        if moved.isEmpty():
            return steps
        steps = durable(
            steps.join(following, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        )


def spelling_groups(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    typo_every: int | None = TYPO_EVERY, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with its likely correct spelling.

    Words need ``least_chars`` code points and ``least_count`` occurrences
    overall.  Near words are exactly one inserted, deleted or replaced code
    point apart.  The form is the most frequent near word (ties: the first in
    code-point order) if it is at least ``ratio`` times as frequent, else
    null; the root follows forms to the last.  Null and empty texts have no
    words; long texts are read whole; repeated rows count each time, equal
    doc_ids have equal typos; other columns are not read; an empty table gives
    no rows.
    """
    counted = durable(word_counts(docs, least_chars, typo_every, doc_id, text).where(F.col("n") >= least_count))
    words, skipped, whole = node_pairs(counted)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = durable(
        near_words(skipped, whole).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
        .select("id", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form"),
                (-F.col("best.less")).alias("most"))
    )
    roots = last_forms(near.where("form is not null"))
    names = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    root_names = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    return (
        words.join(near, "id", "left").join(roots, "id", "left").join(names, "form", "left").join(root_names, "root", "left")
        .select(
            "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("form").isNotNull(), F.col("most")).cast("long").alias("form_n"),
        )
    )


def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))
