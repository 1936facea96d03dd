"""Alignment against the libraries and a plain walk over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fixtures import SCHEMA, no_docs, odd_rows
from test_tokens import ODD, noise
from varlex.llm import alignment, piece_ids

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def plain_groups(text, libraries):
    """Groups of (a ids, b ids), by walking through the ends of both."""
    if not text:
        return []
    a, b = libraries
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    table = piece_ids.printable_bytes()
    bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        name = b.id_to_piece(i)
        bytes_b.append(bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode())
    if b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
        return []
    groups, held, at = [], ([], []), [0, 0]
    sides = [list(zip(ids_a, map(len, bytes_a))), list(zip(ids_b, map(len, bytes_b)))]
    while sides[0] or sides[1]:
        side = 0 if at[0] <= at[1] else 1
        token, size = sides[side].pop(0)
        held[side].append(token)
        at[side] += size
        if at[0] == at[1]:
            groups.append(held)
            held = ([], [])
    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows, libraries):
    groups = [plain_groups(text, libraries) for _, text, *_ in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    holders = Counter(pair for found in links for pair in found)
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (
            row[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
            sum(n for (x, y), n in found.items() if holders[x, y] == most[x]),
            sum(n * holders[p] for p, n in found.items()),
            hashlib.sha256(written(g).encode()).hexdigest() if g else "",
        )
        for row, g, found in zip(rows, groups, links)
    ]


def test_piece_ids_of_the_model(libraries):
    found = piece_ids.model_pieces(PATH_B).encoded(ODD)
    assert found == [np.array(libraries[1].encode(t), "<u4").tobytes() for t in ODD]


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_same_groups(work):
    rng = random.Random(work)
    for _ in range(200):
        total = rng.randint(1, 40)
        a, b = (np.array(sorted({total, *(rng.randint(1, total) for _ in range(rng.randint(0, 30)))})) for _ in "ab")
        group_a, group_b = alignment.merge_groups(a, b, work)
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        assert group_a.tolist() == np.searchsorted(cuts, a).tolist()
        assert group_b.tolist() == np.searchsorted(cuts, b).tolist()
    low, high = alignment.diagonals(a, b, work)
    steps = low + high
    assert steps[0] == 0 and steps[-1] == len(a) + len(b) and (np.diff(steps)[:-1] == work).all()


def test_groups_of_texts(spark, libraries):
    texts = [*ODD, *noise(200, "aé漢🙂 theing\n_-", seed=9), None, "a▁b"]
    rows = [(k, t, "", "", 1, "", "", "") for k, t in enumerate(texts)]
    found = alignment.token_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH_A, PATH_B).collect()
    assert {(r.doc_id, r.groups) for r in found} == {(k, written(plain_groups(t, libraries))) for k, t in enumerate(texts)}


@pytest.mark.parametrize("tokens", [1, 400, alignment.CHUNK_TOKENS])
def test_digests_of_odd_rows(spark, libraries, tokens):
    rows = odd_rows() + [(200 + k, t, "", "", 1, "", "", "") for k, t in enumerate(ODD[-120:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = alignment.alignment_digests(docs, PATH_A, PATH_B, tokens=tokens)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows, libraries), key=str)


def test_large_groups_are_counted_by_ids(monkeypatch, libraries):
    both = alignment.aligner(PATH_A, PATH_B)
    ids = both.encoded(["🙂漢é" * 40, "plain words", "漢" * 300])
    whole = both.align(ids).links(*both.bits)
    monkeypatch.setattr(alignment, "GROUP_LINKS", 2)
    by_ids = both.align(ids).links(*both.bits)
    assert [x.tolist() for x in whole] == [x.tolist() for x in by_ids]


def test_no_rows(spark):
    assert alignment.alignment_digests(no_docs(spark), PATH_A, PATH_B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    found = alignment.alignment_digests(nothing, PATH_A, PATH_B).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, None)), key=str)
