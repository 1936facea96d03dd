"""Token ids in binary files, compressed by Re-Pair grammars that allow random access."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import BoundedCache, chunked_matches, documents, durable, inputs, per_worker
from varlex.session import discard, fresh_path

END_ID = 1
WORD_END = "</w>"
JOINED = 512
# Ids of whole documents under one grammar, about; symbols fit 16 bits.
CHUNK_IDS = 1 << 20
SYMBOLS = 1 << 16
ROUNDS = 8
RULES_A_ROUND = 4096
# A rule costs two symbols and a length, so rarer pairs aren't worth one.
LEAST_USES = 6
# A round that shortens the sequence by less than one part in so many is the last.
LEAST_GAIN = 100
HASH_BITS = 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MAGIC = b"RPG1"
HEADER = "<4sIIII"

# Texts of these characters alone are cut into pre-tokens here; the tokenizer's own rules, written out for them.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")


class Encoder:
    """The library's tokenizer, asked once for each pre-token of a plain text; loaded once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = BoundedCache()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def plain(self, text: str) -> bool:
        """Pre-tokens of such a text don't depend on each other or on normal forms."""
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _learn(self, pieces: Iterable[str]) -> None:
        new = list(self.known.missing(pieces))
        # Many pre-tokens in one text: each ends with the one token that ends a word.
        for k in range(0, len(new), JOINED):
            some = new[k : k + JOINED]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, cuts = ids.tobytes(), (4 * stops).tolist()
                self.known.update(zip(some, (data[a:b] for a, b in zip([0, *cuts], cuts))))
            else:
                self.known.update(zip(some, self._library(some)))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        plain = [self.plain(t) for t in texts]
        short = [PRE_TOKEN.findall(t.lower()) if p and len(t) <= 1 << 20 else None for t, p in zip(texts, plain)]
        self._learn(chain.from_iterable(s for s in short if s))
        found = []
        for pieces in short:
            found.append(b"".join(map(self.known.__getitem__, pieces)) if pieces is not None else b"")
        for k, text in enumerate(texts):
            if short[k] is None and plain[k]:
                parts = bytearray()
                for pieces in chunked_matches(PRE_TOKEN, text.lower()):
                    self._learn(pieces)
                    parts += b"".join(map(self.known.__getitem__, pieces))
                found[k] = bytes(parts)
            elif short[k] is None:
                found[k] = self._library([text])[0]
        return found


def encoder(path: str) -> Encoder:
    return per_worker(("ids", path), lambda: Encoder(path))


def re_pair(ids: np.ndarray, barrier: int = END_ID) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (left, right) and the first nonterminal of a grammar for ``ids``.

    Frequent pairs of neighbours are replaced by nonterminals again and again.
    One round replaces the most frequent pairs together, from left to right
    where they overlap; pairs are counted by hash first and exactly where the
    hash is frequent.  No rule spans the end of a document.
    """
    symbols = ids.astype(np.int64)
    first = int(symbols.max(initial=barrier)) + 1
    rules: list[np.ndarray] = []
    made = 0
    for _ in range(ROUNDS):
        room = min(RULES_A_ROUND, SYMBOLS - first - made)
        if room <= 0 or len(symbols) < 2:
            break
        keys = symbols[:-1] << 32 | symbols[1:]
        hashes = ((keys.view(np.uint64) * MULTIPLIER) >> np.uint64(64 - HASH_BITS)).view(np.int64)
        free = (symbols[:-1] != barrier) & (symbols[1:] != barrier)
        counts = np.bincount(hashes[free], minlength=1 << HASH_BITS)
        bound = max(LEAST_USES, int(np.partition(counts, -room)[-room]) if room < len(counts) else 0)
        at = np.flatnonzero((counts >= bound)[hashes] & free)
        pairs, which, uses = np.unique(keys[at], return_inverse=True, return_counts=True)
        order = np.lexsort((pairs, -uses))[:room]
        order = order[uses[order] >= LEAST_USES]
        if not len(order):
            break
        number = np.full(len(pairs), -1)
        number[order] = np.arange(len(order))
        rule = number[which]
        at, rule = at[rule >= 0], rule[rule >= 0]
        # Of overlapping places every other one is replaced, from the left.
        fresh = np.concatenate(([True], np.diff(at) > 1))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - start) % 2 == 0
        at, rule = at[taken], rule[taken]
        # Rules that lost too many places to others are left out.
        worth = np.bincount(rule, minlength=len(order)) >= LEAST_USES
        at, rule = at[worth[rule]], rule[worth[rule]]
        renumbered = np.cumsum(worth) - 1
        chosen = pairs[order][worth]
        if not len(at):
            break
        symbols[at] = first + made + renumbered[rule]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        rules.append(np.stack((chosen >> 32, chosen & 0xFFFFFFFF), axis=1))
        made += len(chosen)
        before, symbols = len(symbols), symbols[keep]
        if (before - len(symbols)) * LEAST_GAIN < before:
            break
    return symbols, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for; rules only refer to earlier ones."""
    lengths: list[int] = []
    for left, right in rules.tolist():
        lengths.append(
            (lengths[left - first] if left >= first else 1) + (lengths[right - first] if right >= first else 1)
        )
    return np.array(lengths, np.int64)


def packed(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A chunk of whole documents: grammar, where each document starts, and the symbols.

    Layout, little-endian: header (magic, documents, rules, first nonterminal,
    symbols), doc_id int64 and null flag uint8 by document, ids and first
    symbol uint32 by document, left, right and expansion length uint32 by
    rule, symbols uint16 (uint32 if the vocabulary leaves no room).
    """
    symbols, rules, first = re_pair(ids)
    lengths = expansion_lengths(rules, first)
    sizes = np.where(symbols >= first, lengths[np.maximum(symbols - first, 0)] if len(lengths) else 1, 1)
    starts = np.searchsorted(np.concatenate(([0], np.cumsum(sizes))), np.cumsum(counts) - counts)
    wide = "<u2" if first + len(rules) <= SYMBOLS else "<u4"
    return b"".join(
        (
            struct.pack(HEADER, MAGIC, len(doc_ids), len(rules), first, len(symbols)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(),
            rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(wide).tobytes(),
        )
    )


class Chunk:
    """A packed chunk, read back."""

    def __init__(self, data: bytes):
        magic, documents_, rules, self.first, symbols = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a chunk of token ids")
        at = struct.calcsize(HEADER)

        def array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        ids, null = array("<i8", documents_), array("u1", documents_)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.counts, self.starts = array("<u4", documents_), array("<u4", documents_)
        self.rules = array("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = array("<u4", rules).astype(np.int64)
        self.symbols = array("<u2" if self.first + rules <= SYMBOLS else "<u4", symbols)
        self._expand()

    def _expand(self) -> None:
        """All expansions one behind the other; terminals stand for themselves in front."""
        begins = np.concatenate(([0], np.cumsum(self.lengths)))
        table = np.empty(int(begins[-1]), np.uint32)
        first, starts, lengths = self.first, begins.tolist(), self.lengths.tolist()
        for k, (left, right) in enumerate(self.rules.tolist()):
            to = starts[k]
            for symbol in (left, right):
                if symbol < first:
                    table[to] = symbol
                    to += 1
                else:
                    n = lengths[symbol - first]
                    table[to : to + n] = table[starts[symbol - first] : starts[symbol - first] + n]
                    to += n
        self.table = np.concatenate((np.arange(first, dtype=np.uint32), table))
        self.begins = np.concatenate((np.arange(first), begins[:-1] + first))
        self.sizes = np.concatenate((np.ones(first, np.int64), self.lengths))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids that symbols from ``start`` to ``end`` stand for."""
        symbols = self.symbols[start:end].astype(np.int64)
        sizes = self.sizes[symbols]
        shift = self.begins[symbols] - (np.cumsum(sizes) - sizes)
        return self.table[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def document(self, k: int) -> np.ndarray:
        """The ids of one document, without expanding the others."""
        end = int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.symbols)
        return self.ids(int(self.starts[k]), end)


def write_ids(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every row's whole text and write the ids, end id behind each document, to ``path``.

    Rows lie in ascending doc_id order (null first; equal ids by text, then in
    any order) over shards, and in each over chunks of whole documents with
    about a million ids and a Re-Pair grammar of their own.  ``path`` becomes
    a Parquet folder (shard, chunk, documents, n_tokens, payload) with the
    binary chunks as payload.  Null and empty texts are an end id alone;
    special strings are what the library makes of them; other columns are
    not read; an empty table gives an empty folder.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        number = held = 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []

        def written() -> pa.RecordBatch:
            counts = np.array([len(p) // 4 for p in parts], np.int64)
            payload = packed(doc_ids, counts, np.frombuffer(b"".join(parts), "<u4"))
            row = [[shard], [number], [len(doc_ids)], [int(counts.sum())]]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(v, pa.int64()) for v in row), pa.array([payload], pa.binary())],
                ["shard", "chunk", "documents", "n_tokens", "payload"],
            )

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode.encoded(texts)):
                doc_ids.append(key)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= CHUNK_IDS:
                    yield written()
                    number += 1
                    doc_ids, parts, held = [], [], 0
        if doc_ids:
            yield written()

    rows = inputs(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"),
    )
    ordered = rows.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    schema = "shard long, chunk long, documents long, n_tokens long, payload binary"
    ordered.select("doc_id", "text").mapInArrow(scan, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    ``start`` is the number of ids of all documents before it: those of the
    shards before, of the chunks before in the shard, and of the documents
    before in the chunk.
    """
    files = spark.read.parquet(path)
    before = F.expr("sum(n_tokens) over (partition by shard order by chunk) - n_tokens")
    chunks = files.select("shard", "chunk", "n_tokens").withColumn("in_shard", before)
    # One row for each shard.
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("ids")).select(
        "shard", F.expr("sum(ids) over (order by shard) - ids").alias("before_shard")
    )
    offsets = chunks.join(shards, "shard").select("shard", "chunk", (F.col("in_shard") + F.col("before_shard")).alias("offset"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "payload"))):
                chunk = Chunk(payload)
                ids = chunk.ids().astype("<u4")
                ends = np.cumsum(chunk.counts.astype(np.int64))
                starts = ends - chunk.counts
                crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard)), pa.array(np.full(n, number)), pa.array(chunk.doc_ids, pa.int64()),
                        pa.array(starts), pa.array(chunk.counts.astype(np.int64)), pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "chunk", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    schema = "shard long, chunk long, doc_id long, place long, n_tokens long, ids_crc32 long"
    found = files.select("shard", "chunk", "payload").mapInArrow(scan, schema)
    return found.join(offsets, ["shard", "chunk"]).select(
        "doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_re_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    path = fresh_path(spark, "token-ids")
    try:
        write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path)
        return durable(read_ids(spark, path))
    finally:
        discard(spark, path)
