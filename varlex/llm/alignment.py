"""Cross-tokenizer alignment: merge-path pieces of token ends, stitched into groups of tokens that cover the same bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import documents, durable, inputs, per_worker
from varlex.llm.piece_ids import SPACE, byte_pieces, model_pieces

# Token ends of both sides that one merge-path piece holds.
WORK = 1 << 16
# Tokens of side A that a chunk of documents holds at least, where there are so many.
CHUNK_TOKENS = 1 << 18
# What a worker keeps of each side's pieces; two workers share an executor with the other arrays.
CACHE_BYTES = 160_000_000
# Links of one group that are written out; those of larger groups are counted by ids.
GROUP_LINKS = 4096


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted lists stands after 0, ``work``, 2 * ``work``, ... steps.

    A binary search along each diagonal, all diagonals at once; of equal ends
    that of ``a`` comes first.
    """
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        take = np.zeros(len(steps), bool)
        take[open_] = a[middle[open_]] <= b[steps[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & take, middle + 1, low), np.where(open_ & ~take, middle, high)
    return low, steps - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int) -> np.ndarray:
    """(end, token of a, token of b, whether both end there) of the overlaps that end in one piece."""
    ends = np.concatenate((a, b))
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    of_a, of_b = np.searchsorted(a, ends), np.searchsorted(b, ends)
    cut = (np.searchsorted(a, ends, "right") > of_a) & (np.searchsorted(b, ends, "right") > of_b)
    return np.array((ends, at_a + of_a, at_b + of_b, cut))


def merge_groups(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of both sides, from their ascending ends.

    The merge of the ends is divided into pieces of ``work`` steps each, which
    only need their own ends.  Where an end of a closes one piece and the same
    end of b opens the next, the two halves are one overlap and a cut.
    """
    at_a, at_b = diagonals(a, b, work)
    found: list[np.ndarray] = []
    for i, j, to_i, to_j in zip(at_a[:-1].tolist(), at_b[:-1].tolist(), at_a[1:].tolist(), at_b[1:].tolist()):
        piece = piece_overlaps(a[i:to_i], b[j:to_j], i, j)
        if found and found[-1].shape[1] and piece.shape[1] and found[-1][0, -1] == piece[0, 0]:
            found[-1][3, -1] = 1
            piece = piece[:, 1:]
        found.append(piece)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, of_a, of_b, cut = np.concatenate(found, axis=1)
    group = np.cumsum(cut) - cut
    return group[np.searchsorted(of_a, np.arange(len(a)))], group[np.searchsorted(of_b, np.arange(len(b)))]


class Names:
    """Decimal ids with the mark behind them: "," or "|" for side A, "," or ";" for side B."""

    def __init__(self, size_a: int, size_b: int):
        texts = [[b"%d%s" % (i, mark) for i in range(n)] for n, marks in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for mark in marks]
        self.table = np.array([t for part in texts for t in part], object)
        self.starts = np.cumsum([0, size_a, size_a, size_b])


@dataclass
class Aligned:
    """A chunk of documents, aligned: tokens and groups of all of them one behind the other."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    doc_a: np.ndarray  # document of each token of side A
    doc_of_group: np.ndarray
    documents: int

    def per_doc(self, values: np.ndarray | None = None) -> np.ndarray:
        """Groups of each document, or the sum of a value of theirs."""
        found = np.bincount(self.doc_of_group, weights=values, minlength=self.documents)
        return np.rint(found).astype(np.int64)

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.doc_of_group)
        return np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)

    def texts(self, names: Names) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        size_a, size_b = self.sizes
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        marked_a, marked_b = self.ids_a.copy(), self.ids_b + names.starts[2]
        marked_a[ends_a - 1] += names.starts[1]
        marked_b[ends_b - 1] += names.starts[3] - names.starts[2]
        line = np.empty(len(marked_a) + len(marked_b), np.int64)
        line[np.arange(len(marked_a)) + (ends_b - size_b)[self.group_a]] = marked_a
        line[np.arange(len(marked_b)) + ends_a[self.group_b]] = marked_b
        words = names.table[line].tolist()
        tokens = self.per_doc(size_a + size_b)
        stops = np.cumsum(tokens).tolist()
        return [b"".join(words[stop - n : stop])[:-1] for n, stop in zip(tokens.tolist(), stops)]

    def links(self, bits_a: int, bits_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, a id, b id) of the links as one number each, ascending, and how many there are of it."""
        size_a, size_b = self.sizes
        product = size_a * size_b
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b

        def keys(doc, a, b):
            return doc << (bits_a + bits_b) | a << bits_b | b

        small = np.flatnonzero(product <= GROUP_LINKS)
        count = product[small]
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(size_b[small], count)
        found = [keys(
            np.repeat(self.doc_of_group[small], count),
            self.ids_a[np.repeat(first_a[small], count) + inside // width],
            self.ids_b[np.repeat(first_b[small], count) + inside % width],
        )]
        found, times = np.unique(found[0], return_counts=True)
        large = np.flatnonzero(product > GROUP_LINKS)
        if not len(large):
            return found, times
        # Links of a large group by ids: as many rows as it has different pairs of ids.
        parts, weights = [found], [times]
        for g in large.tolist():
            a, of_a = np.unique(self.ids_a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            b, of_b = np.unique(self.ids_b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            parts.append(keys(self.doc_of_group[g], a[:, None], b).ravel())
            weights.append((of_a[:, None] * of_b).ravel())
        found, which = np.unique(np.concatenate(parts), return_inverse=True)
        return found, np.rint(np.bincount(which, np.concatenate(weights))).astype(np.int64)


class Aligner:
    """Both tokenizers, loaded once per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_pieces(path_a, special=False), model_pieces(path_b)
        for side in (self.a, self.b):
            side.known.limit = CACHE_BYTES
        self.bits = len(self.a.lengths).bit_length(), len(self.b.lengths).bit_length()
        self.names = Names(len(self.a.lengths), len(self.b.lengths))

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by both sides; none where the joined bytes of one aren't those of a blank and the text."""
        none = np.zeros(0, np.int64)
        given = [k for k, t in enumerate(texts) if t and SPACE not in t]
        found = [(none, none)] * len(texts)
        side_a = self.a.encoded([" " + texts[k] for k in given])
        side_b = self.b.encoded([texts[k] for k in given])
        for k, a, b in zip(given, side_a, side_b):
            ids = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            size = 1 + len(texts[k].encode("utf-8", "surrogatepass"))
            if int(self.a.lengths[ids[0]].sum()) != size or int(self.b.lengths[ids[1]].sum()) != size:
                continue
            if self.b.broken and self.b.spelled(b) != b" " + texts[k].encode("utf-8", "surrogatepass"):
                continue
            found[k] = ids
        return found

    def align(self, ids: list[tuple[np.ndarray, np.ndarray]], work: int = WORK) -> Aligned:
        ids_a, ids_b = (np.concatenate([i[side] for i in ids]) for side in (0, 1))
        group_a, group_b = merge_groups(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]), work)
        doc_a = np.repeat(np.arange(len(ids)), [len(i[0]) for i in ids])
        opens = np.flatnonzero(np.diff(group_a, prepend=-1))
        return Aligned(ids_a, ids_b, group_a, group_b, doc_a, doc_a[opens], len(ids))


def aligner(path_a: str, path_b: str) -> Aligner:
    return per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def _chunks(batches: Iterable[pa.RecordBatch], both: Aligner, tokens: int) -> Iterator[tuple[pa.Array, Aligned]]:
    """doc_ids and alignment of documents with so many tokens in all, or more with the last one."""
    names, ids, held = [], [], 0
    for batch in batches:
        for name, found in zip(batch.column("doc_id").to_pylist(), both.encoded(batch.column("text").to_pylist())):
            names.append(name)
            ids.append(found)
            held += len(found[0])
            if held >= tokens:
                yield pa.array(names, pa.int64()), both.align(ids)
                names, ids, held = [], [], 0
    if names:
        yield pa.array(names, pa.int64()), both.align(ids)


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return inputs(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def token_groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups): the groups of every row's whole text, as ``a1,a2|b1;a3|b2,b3`` with decimal ids.

    Side A encodes a blank and the text by a byte-level tokenizer, side B the
    text by a piece model that adds the blank itself.  Null and empty texts,
    and those whose joined tokens of either side differ from blank and text,
    have no groups ('').  Repeated rows and equal or null doc_ids keep one row
    each; other columns are not read; an empty table gives no rows.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for names, found in _chunks(batches, both, CHUNK_TOKENS):
            texts = [t.decode() for t in found.texts(both.names)]
            yield pa.RecordBatch.from_arrays([names, pa.array(texts, pa.string())], ["doc_id", "groups"])

    return _plain(docs, doc_id, text).mapInArrow(scan, "doc_id long, groups string")


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<u4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)


def _one(value) -> pa.Array:
    """A column of one row; lists as they are, without a Python object for each value."""
    if isinstance(value, int | bytes):
        return pa.array([value])
    values = value if isinstance(value, pa.Array) else pa.array(value, pa.string() if isinstance(value, list) else None)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


COLUMNS = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, holders array<int>, sizes binary, steps binary, times binary"


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each chunk of documents: their digests, and which id pairs each of them holds linked.

    ``pairs`` are the chunk's different id pairs (ascending), ``holders`` how
    many of its documents hold each.  ``sizes``, ``steps`` and ``times`` are
    compressed lists: pairs of each document, places of these pairs among the
    chunk's (as steps from one to the next) and their links.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        bits = sum(both.bits)
        for number, (names, found) in enumerate(_chunks(batches, both, tokens)):
            size_a, size_b = found.sizes
            keys, times = found.links(*both.bits)
            pairs, place = np.unique(keys & ((1 << bits) - 1), return_inverse=True)
            doc = keys >> bits
            steps = np.diff(place, prepend=0)
            opens = np.flatnonzero(np.diff(doc, prepend=-1))
            steps[opens] = place[opens]
            shas = [hashlib.sha256(t).hexdigest() if t else "" for t in found.texts(both.names)]
            row = {
                "chunk": TaskContext.get().partitionId() << 32 | number, "doc_ids": names, "n_a": found.per_doc(size_a),
                "n_b": found.per_doc(size_b), "n_groups": found.per_doc(), "n_links": found.per_doc(size_a * size_b),
                "groups_sha256": shas, "pairs": pairs, "holders": np.bincount(place, minlength=len(pairs)).astype(np.int32),
                "sizes": _packed(np.bincount(doc, minlength=found.documents)), "steps": _packed(steps), "times": _packed(times),
            }
            yield pa.RecordBatch.from_arrays([_one(v) for v in row.values()], names=list(row))

    return docs.mapInArrow(scan, COLUMNS)


def linked_counts(chunks: DataFrame, bits_b: int) -> DataFrame:
    """(pair, count, best): how many documents hold an id pair linked, and whether no pair of its A id has more."""
    counts = durable(
        chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count"))
    )
    # One row for each A id: never more than the vocabulary has tokens.
    most = counts.groupBy(F.shiftright("pair", bits_b).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright(counts["pair"], bits_b) == most["a"]).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def alignment_digests(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    Groups are those of ``token_groups``.  Links are all pairs of an A and a B
    token in one group; the count of a link is the number of documents that
    hold its id pair linked.  ``n_best`` are the links whose count no other
    pair of their A id exceeds, ``count_sum`` sums the counts over links.
    Texts without tokens have zeros and ''.  Odd rows are treated as in
    ``token_groups``.

    Counts come back to a chunk of documents once for each of its different
    id pairs, not once for each document and pair.
    """
    bits_b = aligner(path_a, path_b).bits[1]
    chunks = durable(aligned_chunks(_plain(docs, doc_id, text), path_a, path_b, tokens))
    counts = linked_counts(chunks, bits_b)
    wanted = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = wanted.join(counts, "pair").groupBy("chunk").agg(
        F.collect_list(F.struct("place", "count", "best")).alias("told")
    )
    columns = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    joined = chunks.select("chunk", *columns, "sizes", "steps", "times").join(told, "chunk", "left").select(
        *columns, "sizes", "steps", "times", F.col("told.place").alias("place"), F.col("told.count").alias("count"),
        F.col("told.best").alias("best"),
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes, steps, times = (_unpacked(row[c].as_py()) for c in ("sizes", "steps", "times"))
                sums = np.zeros((2, len(sizes)), np.int64)
                if row["place"].is_valid:
                    place = row["place"].values.to_numpy()
                    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
                    count[place] = row["count"].values.to_numpy()
                    best[place] = row["best"].values.to_numpy(zero_copy_only=False)
                    # Steps start anew in each document.
                    held = np.flatnonzero(sizes)
                    stops = np.cumsum(sizes[held])
                    total = np.cumsum(steps)
                    before = np.append(0, total[stops[:-1] - 1])
                    at = total - np.repeat(before, sizes[held])
                    sums[0, held] = np.add.reduceat(times * best[at], stops - sizes[held])
                    sums[1, held] = np.add.reduceat(times * count[at], stops - sizes[held])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")),
                        pa.array(sums[0]), pa.array(sums[1]), row["groups_sha256"].values,
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return joined.mapInArrow(
        scan, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_digests(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
