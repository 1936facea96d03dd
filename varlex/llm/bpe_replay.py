"""Byte-level BPE: merges replayed over a corpus of words by an inverted index of token pairs."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import BoundedCache, chunked_matches, documents, forget_others, inputs, per_worker

END = -1
SHIFT = 32


class Vocabulary:
    """Ranks by token bytes; a token's id is its rank.

    ``pairs`` has the rank of the merge for every pair of tokens that joins to
    a token, keyed by ``left << SHIFT | right``.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.words = BoundedCache()

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, END where the pair doesn't merge."""
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], END)


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once per Python worker."""
    return per_worker(("bpe", path, pattern), lambda: Vocabulary(path, pattern))


def replay(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of each word (at least one byte each) as little-endian 32-bit integers.

    All words lie in one array of token ids, linked to their neighbours.  The
    index lists the positions at which the left part of a pair lies, by the
    rank of its merge.  The lowest rank is applied at all its positions, from
    left to right, and each merge only looks up the pairs with its two
    neighbours anew.  Where a merge makes a pair of a lower rank, that comes
    first and the remaining positions wait, so each word sees the lowest,
    leftmost pair of its own at any time.
    """
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(lengths) - 1
    total = len(first)
    pair_ranks = np.full(total, END, np.int64)
    pair_ranks[:-1] = vocab.lookup(first[:-1] << SHIFT | first[1:])
    pair_ranks[ends] = END
    at = np.flatnonzero(pair_ranks >= 0)
    at = at[np.argsort(pair_ranks[at], kind="stable")]
    queue, cuts = np.unique(pair_ranks[at], return_index=True)
    queue = queue.tolist()  # ascending, hence a heap
    index = {r: p.tolist() for r, p in zip(queue, np.split(at, cuts[1:]))}
    symbols = first.tolist()
    after = np.arange(1, total + 1)
    after[ends] = END
    following = after.tolist()
    before = np.arange(-1, total - 1)
    before[ends[:-1] + 1] = END
    previous = before.tolist()
    pairs, push, pop = vocab.pairs.get, heapq.heappush, heapq.heappop
    while queue:
        r = pop(queue)
        positions = index.pop(r, None)
        if positions is None:
            continue
        positions.sort()
        for k, here in enumerate(positions):
            left, right_at = symbols[here], following[here]
            # Positions whose pair has changed meanwhile are out of date.
            if left < 0 or right_at < 0 or pairs(left << SHIFT | symbols[right_at], END) != r:
                continue
            symbols[here], symbols[right_at] = r, END
            following[here] = next_at = following[right_at]
            lower = False
            if next_at >= 0:
                previous[next_at] = here
                new = pairs(r << SHIFT | symbols[next_at], END)
                if new >= 0:
                    if new in index:
                        index[new].append(here)
                    else:
                        index[new] = [here]
                        push(queue, new)
                    lower = new < r
            last_at = previous[here]
            if last_at >= 0:
                new = pairs(symbols[last_at] << SHIFT | r, END)
                if new >= 0:
                    if new in index:
                        index[new].append(last_at)
                    else:
                        index[new] = [last_at]
                        push(queue, new)
                    lower = lower or new < r
            if lower and k + 1 < len(positions):
                if r not in index:
                    push(queue, r)
                index[r] = index.get(r, []) + positions[k + 1 :]
                break
    final = np.array(symbols, np.int64)
    kept = final >= 0
    data = final[kept].astype("<u4").tobytes()
    stops = (4 * np.cumsum(kept)[ends]).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


def learn(pieces: Iterable[str], vocab: Vocabulary) -> None:
    """Put the ids of all pieces, as little-endian bytes, into the worker's cache."""
    known = vocab.words
    missing = known.missing(pieces)
    rest, raw = [], []
    for piece in missing:
        data = piece.encode("utf-8", "surrogatepass")
        whole = vocab.ranks.get(data)
        if whole is not None:
            known[piece] = whole.to_bytes(4, "little")
        else:
            rest.append(piece)
            raw.append(data)
    for piece, ids in zip(rest, replay(raw, vocab)):
        known[piece] = ids


def encode_batch(texts: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    short = [vocab.pattern.findall(t) if len(t) <= 1 << 20 else None for t in texts]
    learn(chain.from_iterable(p for p in short if p), vocab)
    found = [b"".join(map(vocab.words.__getitem__, p)) if p is not None else b"" for p in short]
    for k, text in enumerate(texts):
        if short[k] is None:
            parts = bytearray()
            for chunk in chunked_matches(vocab.pattern, text):
                learn(chunk, vocab)
                parts += b"".join(map(vocab.words.__getitem__, chunk))
            found[k] = bytes(parts)
    return found


def decode(ids: bytes, vocab: Vocabulary, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes that ids stand for, a bounded number of ids at a time."""
    for k in range(0, len(ids), 4 * step):
        yield b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids[k : k + 4 * step], "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text as little-endian 32-bit integers.

    Each match of ``pattern`` is encoded on its own, special strings as
    ordinary text.  A corpus is what one Arrow batch holds: words the worker
    has not met yet are replayed together.  Null and empty texts have no ids;
    repeated rows and equal or null doc_ids keep one row each; other columns
    are not read; an empty table gives no rows.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(("bpe", path, pattern))
        vocab = vocabulary(path, pattern)
        for batch in batches:
            ids = encode_batch([t or "" for t in batch.column("text").to_pylist()], vocab)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = inputs(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, ids binary")


def decoded(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids of each row stand for."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(("bpe", path, pattern))
        vocab = vocabulary(path, pattern)
        for batch in batches:
            data = [b"".join(decode(ids, vocab)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"]
            )

    return encoded.mapInArrow(scan, "doc_id long, ids binary, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded rows, in one pass."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(("bpe", path, pattern))
        vocab = vocabulary(path, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for ids in encode_batch([t or "" for t in batch.column("text").to_pylist()], vocab):
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                whole = hashlib.sha256()
                for part in decode(ids, vocab):
                    whole.update(part)
                second.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = inputs(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def production_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *production_vocabulary())
