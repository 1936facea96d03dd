"""Benchmark passages against brute-force alignment."""

import random

import numpy as np
import pytest

from fixtures import SCHEMA, no_docs, odd_docs, odd_rows, sentence
from varlex.llm import decontaminate


def plain(text):
    return "".join(map(chr, decontaminate.normalised(text)[0]))


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        following = [i]
        for j, d in enumerate(text, 1):
            following.append(min(row[j - 1] + (c != d), row[j] + 1, following[-1] + 1))
        row = following
    return min(row)


def test_normal_form_and_places():
    text = "  Héllo, WORLD!\n\n(x)İ 漢"
    codes, places = decontaminate.normalised(text)
    assert "".join(map(chr, codes)) == "héllo world x İ 漢"
    assert all(text[p].lower() == chr(c) for c, p in zip(codes, places) if c != 32 and chr(c) != "İ")
    assert not len(decontaminate.normalised(None)[0]) and not len(decontaminate.normalised(" .\n")[0])


@pytest.mark.parametrize("seed", range(3))
def test_occurrences_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(30):
        item = sentence(rng, rng.randint(4, 20))
        index = decontaminate.Index(decontaminate.Items([0], [decontaminate.normalised(item)[0]]))
        budget = int(index.budget[0])
        changed = list(plain(item))
        for _ in range(rng.randint(0, budget + 3)):
            k = rng.randrange(len(changed))
            kind = rng.choice("sid")
            if kind == "s":
                changed[k] = rng.choice("xyz")
            elif kind == "i":
                changed.insert(k, rng.choice("xyz"))
            else:
                del changed[k]
        text = f"{sentence(rng, rng.randint(0, 9))} {''.join(changed)} {sentence(rng, rng.randint(0, 9))}"
        least = least_edits(plain(item), plain(text))
        found = list(index.search(["zz", text, None, ""]))
        assert (least <= budget) == bool(found)
        if found:
            row, _, start, end, edits = min(found, key=lambda f: f[4])
            assert row == 1 and edits == least
            assert least_edits(plain(item), plain(text[start:end])) == least


def test_items_at_both_ends_and_over_pieces(monkeypatch):
    rng = random.Random(1)
    item = sentence(rng, 12)
    index = decontaminate.Index(decontaminate.Items([4], [decontaminate.normalised(item)[0]]))
    filler = sentence(rng, 400)
    text = f"{item} {filler} {item} {filler} {item}"
    whole = sorted(f[2:] for f in index.search([text]))
    assert len(whole) == 3
    # Wherever a border between pieces falls, each occurrence is one row.
    for size in (150, *range(len(item), 3 * len(item), 7)):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        assert sorted(f[2:] for f in index.search([text, "", text])) == sorted(whole * 2), size


@pytest.mark.parametrize("seed", range(3))
def test_items_cut_by_a_text_end_between_other_texts(seed):
    rng = random.Random(seed)
    for cut in range(0, 24, 2):
        item = plain(sentence(rng, 60))[:230].strip().ljust(230, "x")
        index = decontaminate.Index(decontaminate.Items([0], [decontaminate.normalised(item)[0]]))
        budget = int(index.budget[0])
        assert budget == 23
        before, after = sentence(rng, 70), sentence(rng, 70)
        for text in (f"{sentence(rng, 40)} {item[:len(item) - cut]}", f"{item[cut:]} {sentence(rng, 40)}", item[cut // 2 :][: len(item) - cut]):
            least = least_edits(item, plain(text))
            found = [f for f in index.search([before, text, after]) if f[0] == 1]
            assert [f[4] for f in found] == [least] and least <= budget
            assert {f[0] for f in index.search([after, "", text, before])} == {2}
            assert least_edits(item, plain(text[found[0][2] : found[0][3]])) == least


def test_tables_with_odd_rows(spark):
    rows = odd_rows()
    items = [(7, rows[3][1]), (8, None), (9, "  "), (10, "short"), (11, rows[3][1]), (12, sentence(random.Random(77), 30))]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = decontaminate.contaminated(odd_docs(spark), benchmark).collect()
    hits = {(r["doc_id"], r["item_id"]) for r in found}
    with_base = [r[0] for r in rows if r[1] and plain(rows[3][1]) in plain(r[1])]
    assert {(d, i) for d in with_base for i in (7, 11)} <= hits
    assert {i for _, i in hits} <= {7, 11}
    kept = decontaminate.drop_contaminated(odd_docs(spark), benchmark)
    assert kept.columns == odd_docs(spark).columns
    item = plain(rows[3][1])
    budget = len(item) * decontaminate.EDIT_PERCENT // 100
    assert kept.count() == sum(least_edits(item, plain(r[1])) > min(budget, (len(item) - 8) // 8) for r in rows)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rows = odd_rows()
    benchmark = spark.createDataFrame([(k, rows[k][1]) for k in range(8)], "item_id long, text string")
    whole = sorted(map(str, decontaminate.contaminated(odd_docs(spark), benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert sorted(map(str, decontaminate.contaminated(odd_docs(spark), benchmark).collect())) == whole
    assert len(whole) >= 8


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd_docs(spark), benchmark).count() == 0
    assert decontaminate.drop_contaminated(odd_docs(spark), benchmark).count() == len(odd_rows())
    some = spark.createDataFrame([(1, "one passage of a benchmark")], "item_id long, text string")
    assert decontaminate.contaminated(no_docs(spark), some).count() == 0


def test_alignment_at_the_borders():
    item, text = (np.array([ord(c) for c in s]) for s in ("abcd", "xabcdx"))
    assert decontaminate.aligned(item, text, -2, 6) == (0, 5)
    assert decontaminate.aligned(item, item, 0, 0) == (0, 4)
    assert SCHEMA
