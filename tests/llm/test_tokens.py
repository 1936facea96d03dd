"""Encoding, counting and id files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from fixtures import no_docs, odd_docs, odd_rows
from varlex.llm import bpe_replay, repair_output, token_counts
from varlex.session import discard, fresh_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def noise(count, alphabet, seed=5, most=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(count)]


ODD = [*noise(400, "aab bcß é漢字🙂\n\t '0123.,theIn▁<s>|\x00\xa0"), "a" * 3000, "ab" * 2000, " " * 500, "\n\n a", "ththe" * 99]


@pytest.fixture(scope="module")
def vocab():
    return bpe_replay.vocabulary(*bpe_replay.production_vocabulary())


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_replay_gives_the_librarys_ids(vocab, library):
    found = bpe_replay.encode_batch(ODD, vocab)
    assert found == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in ODD]
    assert [b"".join(bpe_replay.decode(ids, vocab)).decode() for ids in found] == ODD


def test_replay_with_a_cache_that_is_too_small(vocab, library):
    texts = ODD[:50]
    kept, vocab.words = vocab.words, type(vocab.words)(1000)
    try:
        assert bpe_replay.encode_batch(texts, vocab) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    finally:
        vocab.words = kept


def test_lower_rank_first_inside_a_word():
    # "ab" merges late, "bc" early, and "abc" before both: the leftmost lowest pair of a word goes first.
    vocab = object.__new__(bpe_replay.Vocabulary)
    vocab.ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 400, b"ca": 301}
    library = tiktoken.Encoding("tiny", pat_str=r"\w+", mergeable_ranks=vocab.ranks, special_tokens={})
    vocab.pairs = {}
    for token, rank in vocab.ranks.items():
        for cut in range(1, len(token)):
            if token[:cut] in vocab.ranks and token[cut:] in vocab.ranks:
                vocab.pairs[vocab.ranks[token[:cut]] << bpe_replay.SHIFT | vocab.ranks[token[cut:]]] = rank
    vocab.byte_ids = np.arange(256)
    vocab.pair_keys = np.array(sorted(vocab.pairs))
    vocab.pair_ranks = np.array([vocab.pairs[k] for k in vocab.pair_keys.tolist()])
    words = noise(300, "abc", most=12)
    words = [w for w in words if w and w.encode() not in vocab.ranks]
    found = bpe_replay.replay([w.encode() for w in words], vocab)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode_ordinary(w) for w in words]


def test_digests_of_odd_rows(spark, library):
    path, pattern = bpe_replay.production_vocabulary()
    found = {tuple(r) for r in bpe_replay.digests(odd_docs(spark), path, pattern).collect()}
    expected = set()
    for doc_id, text, *_ in odd_rows():
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        data = (text or "").encode()
        expected.add((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()))
    assert found == expected
    assert bpe_replay.digests(no_docs(spark), path, pattern).count() == 0


def test_encode_and_decode_tables(spark):
    path, pattern = bpe_replay.production_vocabulary()
    encoded = bpe_replay.encode(odd_docs(spark), path, pattern)
    texts = [bytes(r["data"]).decode() for r in bpe_replay.decoded(encoded, path, pattern).collect()]
    assert sorted(texts) == sorted(r[1] or "" for r in odd_rows())


def test_counts_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.counter(PIECES).counted(ODD) == [len(model.encode(t)) for t in ODD]


def test_counts_of_odd_rows(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.token_counts(odd_docs(spark), PIECES, limit=50).collect()
    expected = []
    for doc_id, text, *_ in odd_rows():
        n = len(model.encode(text or ""))
        expected.append((doc_id, len((text or "").encode()), n, n > 50))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(no_docs(spark), PIECES).count() == 0


def test_ids_of_plain_and_other_texts_are_the_librarys():
    encode = repair_output.encoder(WORDS)
    texts = [
        *ODD, *noise(300, "aAbBßÉéÿÞ \n\t'0123.,theisd½²ªµº¼×÷|<>¡"), *noise(200, "a\xa0\x85İ́\xad'sS "),
        "<|endoftext|> a", "x<|startoftext|>", "'S it's I'LL",
    ]
    found = encode.encoded(texts)
    assert found == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for size, alphabet in ((0, 5), (1, 5), (5000, 3), (20_000, 50), (300, 60_000)):
        counts, parts = [], []
        while sum(counts) < size:
            ids = np.append(rng.integers(2, 2 + alphabet, rng.integers(0, 60)), 1)
            counts.append(len(ids))
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        data = repair_output.packed(list(range(len(parts))), np.array(counts, np.int64), ids)
        chunk = repair_output.Chunk(data)
        assert chunk.ids().tolist() == ids.tolist()
        for k in range(0, len(parts), 7):
            assert chunk.document(k).tolist() == parts[k].tolist()
        if alphabet == 3:
            assert len(chunk.rules) and len(chunk.symbols) < len(ids) / 2
    same = np.append(np.full(4097, 7), 1)
    assert repair_output.Chunk(repair_output.packed([1], np.array([4098]), same)).ids().tolist() == same.tolist()


def test_id_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repair_output, "CHUNK_IDS", 500)
    encode = repair_output.encoder(WORDS)
    path = fresh_path(spark, "ids")
    repair_output.write_ids(odd_docs(spark), WORDS, path)
    found = sorted(map(tuple, repair_output.read_ids(spark, path).collect()), key=lambda r: r[1])
    ids = lambda t: [*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    expected = sorted(
        (str(r[0]), len(ids(r[1])), zlib.crc32(np.array(ids(r[1]), "<u4").tobytes())) for r in odd_rows()
    )
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == expected
    starts = 0
    for doc_id, start, n, _ in found:
        assert start == starts
        starts += n
    known = [r[0] for r in found if r[0] is not None]
    assert known == sorted(known) and found[0][0] is None
    discard(spark, path)


def test_id_files_of_an_empty_table(spark):
    path = fresh_path(spark, "ids")
    repair_output.write_ids(no_docs(spark), WORDS, path)
    assert repair_output.read_ids(spark, path).count() == 0
    discard(spark, path)
