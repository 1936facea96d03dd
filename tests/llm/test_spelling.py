"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from fixtures import SCHEMA, no_docs, odd_rows
from varlex.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows, least_chars, least_count, ratio=5, every=199):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_chars and c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return found


def typos(seed=3, words=60, docs=300):
    """Few words, many slips of the pen, runs of equal letters, accents and capitals."""
    rng = random.Random(seed)
    letters = "aabßé×ÿz"
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(words)]
    rows = []
    for k in range(docs):
        text = []
        for _ in range(rng.randint(0, 60)):
            word = known[min(int(rng.expovariate(0.08)), words - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(word) + 1)
                word = rng.choice((word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + "q" + word[at + 1 :]))
            text.append(word.upper() if rng.random() < 0.1 and "ß" not in word and "ÿ" not in word else word)
        rows.append((k % 290, rng.choice((" ", ", ", "1", "\n")).join(text), "en", "s", 1, "", "", ""))
    return rows


@pytest.mark.parametrize("least_chars, least_count, ratio", [(3, 2, 5), (1, 1, 2), (6, 5, 5)])
def test_words_forms_and_roots(spark, least_chars, least_count, ratio):
    rows = typos() + odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = spelling.spelling_groups(docs, least_chars, least_count, ratio)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(rows, least_chars, least_count, ratio)


def test_long_chains_of_forms(spark):
    text = " ".join(w for k, w in enumerate(("aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb")) for _ in range(2 ** k))
    rows = [(1, text, "", "", 1, "", "", "")]
    got = {tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA), 1, 1, 2, None).collect()}
    assert got == expected(rows, 1, 1, 2, every=10**12)
    assert {r[2] for r in got} == {"aabbbbb"}


def test_a_very_long_word_and_no_words(spark):
    long = "ab" * 20_000
    rows = [(k, f"{long} {long}x {long[:-1]}", "", "", 1, "", "", "") for k in range(3)]
    got = {tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA), 6, 1, 5, None).collect()}
    assert {(len(r[0]), r[4], r[1]) for r in got} == {(40_000, 2, None), (40_001, 1, None), (39_999, 1, None)}
    assert spelling.spelling_groups(no_docs(spark)).count() == 0


def test_parts_give_one_trie():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))})
        whole = spelling.TriePart()
        expected_paths = [list(whole.add(w)) for w in words]
        cuts = sorted({0, len(words), *(rng.randrange(len(words) + 1) for _ in range(4))})
        spans = [words[a:b] for a, b in zip(cuts, cuts[1:])]
        summary = []
        for number, span in enumerate(spans):
            part = spelling.TriePart()
            for w in span:
                part.add(w)
            summary.append((number, span[0], span[-1], part.following - 1, part.path))
        starts = spelling._joined(summary)
        found = []
        for number, span in enumerate(spans):
            part = spelling.TriePart(*starts[number])
            found += [list(part.add(w)) for w in span]
        assert found == expected_paths
        assert len({n for p in found for n in p}) == len({w[:k] for w in words for k in range(len(w) + 1)})
