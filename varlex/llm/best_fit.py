"""Best-fit packing: dominance reduction fixes provably optimal sets, best fit packs the rest.

Lengths are bounded by the sequence, so an instance of any size is a histogram
of at most ``capacity`` counts.  The plan made from it is a short list of
patterns (which lengths share a sequence, and how many sequences look so);
pieces find their place by their rank among the pieces of equal length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from varlex.llm.common import documents, durable, inputs
from varlex.llm.piece_ids import byte_pieces

CAPACITY = 1024
END_ID = 2


@dataclass
class Pattern:
    """So many sequences that hold the same lengths: (length, copies) in order."""

    lengths: list[tuple[int, int]]
    sequences: int


class Stock:
    """How many pieces of each length are left; the lengths that are left, ascending."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)

    def take(self, length: int, copies: int) -> None:
        self.left[length] -= copies
        if not self.left[length]:
            del self.left[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def smallest(self, n: int) -> list[int]:
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(self.left[length], n - len(found))
            if len(found) == n:
                break
        return found

    def largest(self, room: int) -> int | None:
        """The largest length that fits."""
        at = bisect_left(self.lengths, room + 1)
        return self.lengths[at - 1] if at else None

    def pairs(self, room: int) -> tuple[int, int]:
        """Of the pairs that fit: the largest sum, and the largest smaller part; zeros if none fits."""
        best = second = 0
        high = len(self.lengths) - 1
        for at, low in enumerate(self.lengths):
            while high >= at and self.lengths[high] + low > room:
                high -= 1
            # The largest partner; a length is its own partner if there are two of it.
            partner = high
            if partner == at and self.left[low] < 2:
                partner = at - 1
            if high < at or partner < at:
                break
            best, second = max(best, low + self.lengths[partner]), low
        return best, second


def dominant_set(stock: Stock, length: int, capacity: int) -> tuple[int, ...] | None:
    """Partners with which a piece of ``length``, already taken out, may be packed for good; None if none is proven.

    A set dominates another that holds the piece if the other's pieces can be
    dealt out to the set's so that each of these is at least as large as what
    it gets: exchanging them makes no packing worse.  Proven are: the piece
    alone where nothing fits; the one partner that fills the sequence, or the
    largest where only one fits; and where at most two fit, the largest alone
    if no pair is larger, or with its best companion if no pair has a larger
    smaller part.
    """
    room = capacity - length
    few = stock.smallest(3)
    if not few or few[0] > room:
        return ()
    most = stock.largest(room)
    if most == room or len(few) < 2 or few[0] + few[1] > room:
        return (most,)
    if len(few) == 3 and sum(few) <= room:
        return None
    best, second = stock.pairs(room)
    if most >= best:
        return (most,)
    stock.left[most] -= 1
    fitting = [n for n in stock.lengths[: bisect_left(stock.lengths, room - most + 1)] if stock.left[n]]
    stock.left[most] += 1
    if fitting and fitting[-1] >= second:
        return (most, fitting[-1])
    return None


def reduce_stock(stock: Stock, capacity: int) -> list[Pattern]:
    """Sets fixed for good, largest lengths first, until no more is proven; they leave ``stock``.

    What proves a set goes on holding while its lengths last, as fewer
    alternatives are left, so equal sets are fixed together.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for length in reversed(list(stock.lengths)):
            while stock.left.get(length):
                stock.take(length, 1)
                partners = dominant_set(stock, length, capacity)
                if partners is None:
                    restore(stock, length)
                    break
                need: dict[int, int] = {}
                for n in partners:
                    need[n] = need.get(n, 0) + 1
                own = 1 + need.pop(length, 0)
                times = min([(stock.left.get(length, 0) + 1) // own, *(stock.left[n] // c for n, c in need.items())])
                if partners:
                    restore(stock, length)
                    stock.take(length, own * times)
                else:
                    times = stock.left.get(length, 0) + 1
                    if times > 1:
                        stock.take(length, times - 1)
                for n, c in need.items():
                    stock.take(n, c * times)
                fixed.append(Pattern([(length, own), *sorted(need.items(), reverse=True)], times))
                again = True
    return fixed


def restore(stock: Stock, length: int) -> None:
    if length not in stock.left:
        insort(stock.lengths, length)
    stock.left[length] = stock.left.get(length, 0) + 1


def best_fit(stock: Stock, capacity: int) -> list[Pattern]:
    """The rest by best fit, largest lengths first: each piece goes where it leaves the least room.

    Sequences that look alike are filled together.  A length splits at most
    one pattern, so there are about as many patterns as lengths.
    """
    open_at: dict[int, list[Pattern]] = {}
    rooms: list[int] = []
    full: list[Pattern] = []

    def put(pattern: Pattern, room: int) -> None:
        if not room:
            full.append(pattern)
            return
        if room not in open_at:
            insort(rooms, room)
            open_at[room] = []
        open_at[room].append(pattern)

    for length in reversed(stock.lengths):
        left = stock.left[length]
        changed: list[tuple[Pattern, int]] = []
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                sequences, over = divmod(left, fits)
                if sequences:
                    changed.append((Pattern([(length, fits)], sequences), capacity - fits * length))
                if over:
                    changed.append((Pattern([(length, over)], 1), capacity - over * length))
                break
            room = rooms[at]
            pattern = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
            fits = room // length
            sequences, over = divmod(left, fits)
            if sequences >= pattern.sequences:
                changed.append((Pattern([*pattern.lengths, (length, fits)], pattern.sequences), room - fits * length))
                left -= fits * pattern.sequences
                continue
            if sequences:
                changed.append((Pattern([*pattern.lengths, (length, fits)], sequences), room - fits * length))
            if over:
                changed.append((Pattern([*pattern.lengths, (length, over)], 1), room - over * length))
            rest = pattern.sequences - sequences - bool(over)
            if rest:
                put(Pattern(pattern.lengths, rest), room)
            left = 0
        for pattern, room in changed:
            put(pattern, room)
    return full + [p for room in rooms for p in open_at[room]]


def packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly so many pieces of each length (1 to ``capacity``)."""
    stock = Stock(counts)
    return reduce_stock(stock, capacity) + best_fit(stock, capacity)


class Places:
    """Where the piece of each length and rank goes."""

    def __init__(self, patterns: list[Pattern]):
        spans: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern in patterns:
            offset = 0
            for length, copies in pattern.lengths:
                spans.setdefault(length, []).append((copies * pattern.sequences, copies, first, offset))
                offset += length * copies
            first += pattern.sequences
        rows, self.first = [], {}
        for length in sorted(spans):
            self.first[length] = len(rows)
            begin = 0
            for pieces, copies, sequence, offset in spans[length]:
                rows.append((length, begin, copies, sequence, offset))
                begin += pieces
        table = np.array(rows, np.int64).reshape(-1, 5).T
        self.lengths, self.begin, self.copies, self.sequence, self.offset = table

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == length)
            low, high = np.searchsorted(self.lengths, [length, length + 1])
            span = low + np.searchsorted(self.begin[low:high], ranks[here], "right") - 1
            inside = ranks[here] - self.begin[span]
            sequence[here] = self.sequence[span] + inside // self.copies[span]
            offset[here] = self.offset[span] + inside % self.copies[span] * length
        return sequence, offset


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, the first piece may be shorter."""
    first = tokens % capacity if tokens > capacity else tokens
    starts = range(first, tokens, capacity)
    return ([(0, first)] if first else []) + [(s, capacity) for s in starts]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every whole text, end id behind, cut to sequences.

    ``ids`` are little-endian unsigned 32-bit integers.  Null and empty texts
    are one piece with the end id alone.  Only documents longer than
    ``capacity`` are cut.  Repeated rows and equal or null doc_ids keep their
    own pieces; other columns are not read; an empty table gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pieces(path, special=True)
        for batch in batches:
            row, number, start, length, data = [], [], [], [], []
            for k, ids in enumerate(encoder.encoded(batch.column("text").to_pylist())):
                ids += end
                for piece, (begin, size) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(k)
                    number.append(piece)
                    start.append(begin)
                    length.append(size)
                    data.append(ids[4 * begin : 4 * (begin + size)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = inputs(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(scan, "doc_id long, piece int, start long, length long, ids binary")


def _numbered(rows: DataFrame, length: str, prefix: str) -> DataFrame:
    """``rows`` with their partition and the rank among its rows of equal length, written once."""
    part, rank = f"{prefix}part", f"{prefix}rank"
    schema = StructType([*rows.schema, StructField(part, IntegerType()), StructField(rank, LongType())])
    names = schema.names

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            lengths = np.asarray(batch.column(length))
            order = np.argsort(lengths, kind="stable")
            values, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
            before = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            ranks = np.empty(len(lengths), np.int64)
            ranks[order] = np.arange(len(lengths)) + np.repeat(before - starts, counts)
            seen.update(zip(values.tolist(), (before + counts).tolist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(lengths), here, np.int32)), pa.array(ranks)], names=names
            )

    return durable(rows.mapInArrow(scan, schema))


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, as few as the method finds.

    ``length`` is an integer column with values from 1 to ``capacity``; others
    and nulls are an error, as such a piece fits nowhere.  All rows and columns
    stay; ties go by the order in which a partition holds them.  The driver
    sees one count for each length.  A piece's rank among those of its length
    is its rank in its own partition behind the counts of the partitions
    before, so no length, however frequent, meets in one task.
    """
    prefix = "_b"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix = "_" + prefix
    checked = rows.withColumn(length, F.when(
        F.col(length).between(1, capacity), F.col(length).cast("long")
    ).otherwise(F.raise_error(F.lit(f"a length is not between 1 and {capacity}")).cast("long")))
    kept = _numbered(checked, length, prefix)
    part, rank, before = f"{prefix}part", f"{prefix}rank", f"{prefix}before"
    counts = durable(kept.groupBy(length, part).agg(F.count("*").alias(before)))
    places = Places(packing({r[0]: r[1] for r in counts.groupBy(length).agg(F.sum(before)).collect()}, capacity))
    # One row for each partition and length: the window sees counts, never pieces.
    earlier = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    ranked = kept.join(offsets, [length, part]).withColumn(rank, F.col(rank) + F.col(before))
    schema = StructType([
        *checked.schema, StructField("sequence_id", LongType(), False), StructField("offset", LongType(), False)
    ])

    names = rows.columns

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.find(np.asarray(batch.column(length)), np.asarray(batch.column(rank)))
            columns = {name: batch.column(name) for name in names}
            columns |= dict(zip(("sequence_id", "offset"), map(pa.array, found)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return ranked.select(*names, rank).mapInArrow(scan, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence's pieces one behind the other."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids")
    )


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut_docs = pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    digested = cut_docs.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digested)
