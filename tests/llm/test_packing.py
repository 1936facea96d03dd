"""Packing against exhaustive search, the tokenizer's library and whole sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fixtures import no_docs, odd_docs, odd_rows
from test_tokens import ODD, noise
from varlex.llm import best_fit, piece_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """Bins of a perfect packing, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        tried = set()
        for i, held in enumerate(bins):
            if held + lengths[k] <= capacity and held not in tried:
                tried.add(held)
                bins[i] += lengths[k]
                place(k + 1, bins)
                bins[i] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(1)
    fixed_sets = 0
    for _ in range(1500):
        capacity = rng.choice((10, 20, 37, 100))
        lengths = [rng.randint(max(1, capacity // rng.choice((3, 5, 10))), capacity) for _ in range(rng.randint(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        stock = best_fit.Stock(counts)
        fixed = sum(p.sequences for p in best_fit.reduce_stock(stock, capacity))
        rest = [n for n, c in stock.left.items() for _ in range(c)]
        assert fixed + fewest(rest, capacity) == fewest(lengths, capacity)
        fixed_sets += fixed
        patterns = best_fit.packing(counts, capacity)
        held = {}
        for p in patterns:
            assert sum(n * c for n, c in p.lengths) <= capacity and p.sequences > 0
            for n, c in p.lengths:
                held[n] = held.get(n, 0) + c * p.sequences
        assert held == counts
    assert fixed_sets > 1000


def test_large_counts_pack_close_to_the_sum():
    rng = random.Random(2)
    counts = {n: rng.randint(0, 10**7) // (1 + n // 50) for n in range(1, 1024)}
    patterns = best_fit.packing(counts)
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert len(patterns) < 4000
    assert sum(p.sequences for p in patterns) <= 1.001 * least


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_the_librarys(special):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = not special
    texts = [*ODD, "<|endoftext|> a", "x <|endoftext|>\n\n  <|endoftext|>b", *noise(300, "aA bB\n\t  <|>\xa0\x85'sé漢🙂0", seed=8)]
    found = piece_ids.byte_pieces(PATH, special).encoded(texts)
    assert found == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_very_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(piece_ids, "LONG", 2000)
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    plain = " ".join("".join(rng.choice("abc,.'s\n") for _ in range(5)) for _ in range(3000))
    texts = [plain, plain.replace("cc", "c\t c"), "\t" * 5000, " <|endoftext|> " + plain]
    found = piece_ids.BytePieces(PATH, True).encoded(texts)
    assert found == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert "".join(piece_ids.safe_blocks(texts[1], 500)) == texts[1]


def test_cut():
    assert best_fit.cut(1, 1024) == [(0, 1)]
    assert best_fit.cut(1024, 1024) == [(0, 1024)]
    assert best_fit.cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert best_fit.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_sequences_of_odd_rows(spark):
    library = Tokenizer.from_file(PATH)
    cut = best_fit.pieces(odd_docs(spark).repartition(3), PATH, capacity=50)
    packed = best_fit.pack(cut, 50)
    rows = packed.collect()
    expected = []
    for doc_id, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        for piece, (start, length) in enumerate(best_fit.cut(len(ids), 50)):
            data = np.array(ids[start : start + length], "<u4").tobytes()
            expected.append((doc_id, piece, start, length, data))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows), key=str) == sorted(expected, key=str)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 50
    whole = {r.sequence_id: bytes(r.ids) for r in best_fit.sequences(packed).collect()}
    assert set(whole) == set(held)
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert best_fit.pack(best_fit.pieces(no_docs(spark), PATH)).count() == 0


def test_pack_keeps_columns_and_refuses_lengths_that_fit_nowhere(spark):
    rows = spark.createDataFrame([(k % 7 + 1, k, "x") for k in range(100)], "length int, sequence int, _bpart string").repartition(4)
    packed = best_fit.pack(rows, 7)
    assert packed.columns == ["length", "sequence", "_bpart", "sequence_id", "offset"]
    assert sorted(r.sequence for r in packed.collect()) == list(range(100))
    assert packed.select("sequence_id").distinct().count() == -(-sum(k % 7 + 1 for k in range(100)) // 7)
    for wrong in ("0", "8", "null"):
        with pytest.raises(Exception, match="not between"):
            best_fit.pack(spark.sql(f"select int({wrong}) length"), 7).collect()


def test_digests_of_the_query(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = best_fit.op12_best_fit(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        for piece, (start, length) in enumerate(best_fit.cut(len(ids), 1024)):
            expected.append((doc_id, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
