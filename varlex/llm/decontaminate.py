"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import documents, forget_others, inputs, per_worker

Q = 8
# Edits an occurrence may have, per cent of the item's characters.
EDIT_PERCENT = 10
# Items that one pass over the documents looks for: at most so many, with so many characters.
BLOCK_ITEMS = 2_000
BLOCK_CHARS = 4_000_000
# Characters of documents that are searched together.
PIECE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
BLANK = 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit; its lower-case form where that is one character."""
    return per_worker("characters", _made_tables)


def _made_tables() -> tuple[np.ndarray, np.ndarray]:
    points = 0x110000
    kept = np.fromiter(map(str.isalnum, map(chr, range(points))), bool, points)
    low = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(points))), np.uint32, points)
    return kept, low


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits, all else as single blanks; and each character's place in the text."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept, low = _tables()
    inside = kept[codes]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    places = np.flatnonzero(keep)
    found = np.where(inside, low[codes], BLANK)[places].astype(np.uint32)
    if len(found) and found[-1] == BLANK:
        return found[:-1], places[:-1]
    return found, places


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram; equal grams have equal hashes."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    hashes = np.zeros(len(codes) - q + 1, np.uint64)
    for k in range(q):
        hashes *= MULTIPLIER
        hashes += codes[k : k + len(hashes)]
    hashes ^= hashes >> np.uint64(29)
    return hashes * MULTIPLIER


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, free_start: bool = True) -> tuple[int, int]:
    """Least edits between an item and a part of a text, and the end of that part.

    Only diagonals (place in the text minus place in the item) from ``low`` to
    ``high`` are walked.  The part may start at any of them, or with
    ``free_start`` false only at the text's start.
    """
    width = high - low + 1
    steps = np.arange(width)
    far = len(item) + width + 1
    row = np.zeros(width, np.int64) if free_start else np.abs(steps + low)
    place = steps + low
    row[(place < 0) | (place > len(text))] = far
    padded = np.full(len(text) + 2 * width + len(item) + 2, -1, np.int64)
    offset = max(0, -low)
    padded[offset : offset + len(text)] = text
    for k, c in enumerate(item):
        chars = padded[offset + low + k : offset + low + k + width]
        following = row + ((chars != c) | (place + k < 0) | (place + k >= len(text)))
        following[:-1] = np.minimum(following[:-1], row[1:] + 1)
        # Characters of the text that the item lacks: cost one for each step along the row.
        row = np.minimum.accumulate(following - steps) + steps
        row[(place + k + 1 < 0) | (place + k + 1 > len(text))] = far
    best = int(row.argmin())
    return int(row[best]), best + low + len(item)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items, normalised; bounded by ``BLOCK_ITEMS`` and ``BLOCK_CHARS``."""

    ids: list
    codes: list[np.ndarray]


class Index:
    """The q-grams of a block: hash, item and place of each, sorted by hash."""

    def __init__(self, items: Items, q: int = Q, percent: int = EDIT_PERCENT):
        self.items, self.q = items, q
        lengths = np.array([len(c) for c in items.codes], np.int64)
        count = np.maximum(lengths - q + 1, 0)
        # One edit spoils at most q grams: an occurrence within the budget shares at least `least` of them.
        self.budget = np.minimum(lengths * percent // 100, np.maximum(count - 1, 0) // q)
        self.least = count - q * self.budget
        self.span = 2 * self.budget + 1
        hashes = [grams(c, q) for c in items.codes]
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(count)), count)
        place = np.concatenate([np.arange(n) for n in count]) if len(count) else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.keys, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of every band with enough shared q-grams.

        Bands of an item are twice as wide as the diagonals an occurrence can
        spread over and overlap by half, so each occurrence lies whole in one.
        """
        none = np.empty(0, np.int64)
        hashes = grams(codes, self.q)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return none, none
        found = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[found] == hashes[at]
        at, found = at[same], found[same]
        times = self.times[found]
        total = int(times.sum())
        within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[found], times) + within
        item = self.item[entry]
        longest = max((len(c) for c in self.items.codes), default=0)
        # Diagonals from 0 on: shifted by the longest item.
        diagonal = np.repeat(at, times) - self.place[entry] + longest
        band = diagonal // self.span[item]
        bands = (len(codes) + longest) // int(self.span.min()) + 3
        # A hit counts for the band that starts at its own strip and for the one before.
        # Each q-gram of the item counts once for a band, however often the text has it there.
        key = np.concatenate((item * bands + band + 1, item * bands + band))
        key = key * longest + np.tile(self.place[entry], 2)
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] // longest if total else key
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else none
        counts = np.diff(np.append(edge, len(key)))
        item, band = key[edge] // bands, key[edge] % bands - 1
        enough = counts >= self.least[item]
        item, band = item[enough], band[enough]
        return item, band * self.span[item] - longest

    def occurrences(self, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of occurrences within the budget, those of an item apart from each other.

        ``codes`` holds texts with one character behind each that no text
        has, ``starts`` where each begins and where the next one would.  A
        region is aligned in every text it touches, on that text alone.
        """
        found: dict[int, list[tuple[int, int, int]]] = {}
        items, lows = self.regions(codes)
        highs = lows + 2 * self.span[items] - 1
        # Texts that end behind the first diagonal and start no later than the last one.
        begin = np.searchsorted(starts[1:] - 1, lows, "right")
        stop = np.searchsorted(starts[:-1], highs, "right")
        for k, low, high, a, b in zip(*(x.tolist() for x in (items, lows, highs, begin, stop))):
            item, budget = self.items.codes[k], int(self.budget[k])
            for own in range(a, b):
                first = max(int(starts[own]), low)
                part = codes[first : min(int(starts[own + 1]) - 1, high + len(item) + 1)].astype(np.int64)
                if len(part) < len(item) - budget:
                    continue
                at = part.tobytes().find(item.astype(np.int64).tobytes())
                if at >= 0 and at % 8 == 0:  # as it is, so there is nothing to align
                    found.setdefault(k, []).append((0, first + at // 8, first + at // 8 + len(item)))
                    continue
                edits, end = aligned(item, part, low - first, high - first)
                if edits > budget:
                    continue
                # Backwards from the end: where the occurrence starts.
                back = part[:end][::-1]
                _, length = aligned(item[::-1], back, -budget, budget, free_start=False)
                found.setdefault(k, []).append((edits, first + end - length, first + end))
        kept = []
        for k, places in found.items():
            taken: list[tuple[int, int, int]] = []
            for edits, start, end in sorted(places):
                if all(end <= s or start >= e for _, s, e in taken):
                    taken.append((edits, start, end))
            kept += [(k, start, end, edits) for edits, start, end in taken]
        return kept

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) with places in the texts as they are."""
        longest = max((len(c) + int(b) for c, b in zip(self.items.codes, self.budget)), default=0)
        pending: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        size = 0
        # Of each (text, item), how far what earlier pieces found reaches, and the piece that found it last.
        ends: dict[tuple[int, int], tuple[int, int, int]] = {}

        def new() -> Iterator[tuple[int, int, int, int, int]]:
            for piece, (row, item, start, end, edits) in sorted(self._searched(pending)):
                before, last, here = ends.get((row, item), (0, piece, 0))
                if piece != last:
                    before, here = max(before, here), 0
                # A later piece sees the rest of an occurrence that starts before it.
                if start >= before:
                    ends[row, item] = (before, piece, max(here, end))
                    yield row, item, start, end, edits

        for row, text in enumerate(texts):
            codes, places = normalised(text)
            # Long texts in pieces that overlap by more than an occurrence, which counts where it starts.
            for start in range(0, max(1, len(codes)), PIECE):
                end = start + PIECE + longest
                pending.append((row, codes[start:end], places[start:end], PIECE if end < len(codes) else end - start))
                size += len(pending[-1][1])
                if size >= PIECE:
                    yield from new()
                    pending, size = [], 0
        yield from new()

    def _searched(
        self, pending: list[tuple[int, np.ndarray, np.ndarray, int]]
    ) -> Iterator[tuple[int, tuple[int, int, int, int, int]]]:
        """(first place of the piece, occurrence) of the pieces put together."""
        if not pending:
            return
        # A character that no text has keeps q-grams from reaching over texts.
        gap = np.array([0], np.uint32)
        joined = np.concatenate([x for _, codes, _, _ in pending for x in (codes, gap)])
        starts = np.cumsum([0] + [len(codes) + 1 for _, codes, _, _ in pending])
        for k, start, end, edits in self.occurrences(joined, starts):
            at = int(np.searchsorted(starts, start, "right")) - 1
            row, _, places, counted = pending[at]
            first, last = start - int(starts[at]), end - int(starts[at])
            if first < counted:
                yield int(places[0]), (row, k, int(places[first]), int(places[last - 1]) + 1, edits)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks of bounded size; one partition at a time passes the driver."""
    ids, codes, chars = [], [], 0
    for key, value in inputs(benchmark, item_id=item_id, text=text).toLocalIterator():
        found = normalised(value)[0]
        if len(found) < Q:
            continue
        if ids and (len(ids) >= BLOCK_ITEMS or chars + len(found) > BLOCK_CHARS):
            yield Items(ids, codes)
            ids, codes, chars = [], [], 0
        ids.append(key)
        codes.append(found)
        chars += len(found)
    if ids:
        yield Items(ids, codes)


MATCHES = "doc_id long, item_id long, start long, end long, edits long, item_chars long"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_chars): every occurrence of every item in every text.

    Letters and digits are compared in lower case, anything else counts as one
    blank.  An occurrence is a part of a text within 10 % edits of the item
    (fewer for items so short that the q-gram lemma would leave nothing to
    count: at least one whole q-gram has to be left).  ``start`` and ``end``
    are characters of the text as it is.  The items are the query set: they
    are searched for in blocks of bounded size, each in one pass over all
    documents.  Items with fewer than eight characters, null or blank ones
    have no q-gram and no occurrence; null and empty texts have none; texts
    of any length are searched whole.  Equal items are reported each; repeated
    rows and equal or null doc_ids are each searched; other columns are not
    read; empty tables on either side give no rows.
    """
    rows = inputs(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], MATCHES)
    for items in blocks(benchmark, item_id, item_text):

        def scan(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            forget_others("characters")
            index = Index(items)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                matches = [
                    (ids[row], items.ids[k], start, end, edits, len(items.codes[k]))
                    for row, k, start, end, edits in index.search(batch.column("text").to_pylist())
                ]
                columns = list(zip(*matches)) or [()] * 6
                names = ["doc_id", "item_id", "start", "end", "edits", "item_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        found = found.unionByName(rows.mapInArrow(scan, MATCHES))
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds nothing, with all their columns."""
    for items in blocks(benchmark, item_id, item_text):

        def scan(batches: Iterable[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            forget_others("characters")
            index = Index(items)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for match in index.search(batch.column(text).to_pylist()):
                    clean[match[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op10_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
