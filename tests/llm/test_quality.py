"""Adaptive quality rules against SQL and plain versions."""

import re
from collections import Counter

from fixtures import SCHEMA, no_docs, odd_docs, odd_rows, sentence
from varlex.llm import quality


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            repeated |= {k, k + 1, k + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
    )


def test_measures_equal_a_plain_version(spark):
    texts = [r[1] for r in odd_rows()] + [
        "a b c a b c", "a a a a", "x\n\nx\nx \nx", "#a *b|<>", "a b c d a b c e", "é é é\x0b\x0c漢 漢 漢", "\n\n", "a b", "a b c",
    ]
    for text in texts:
        assert quality.measures(None if text is None else text.encode()) == plain_measures(text), text


def plain_bucket(v):
    drop = max(v.bit_length() - 1 - quality.KEPT_BITS, 0)
    return v >> drop << drop


def plain_verdicts(rows, min_group):
    """Thresholds straight from sorted lists of bucketed values."""
    measured = [(r, plain_measures(r[1])) for r in rows]
    names = dict(zip(quality.MEASURES, range(5)))
    failed = lambda m: m[0] < quality.MIN_WORDS or 100 * m[4] > quality.MAX_REPEAT_PERCENT * m[0]
    value = lambda rule, m: rule.scale * m[names[rule.above]] // m[names[rule.below]]
    good = [(r, m) for r, m in measured if not failed(m)]
    out = []
    for r, m in measured:
        kept = not failed(m)
        for rule in quality.RULES if kept else ():
            own = [x for x in good if (x[0][2] or "", x[0][3] or "") == (r[2] or "", r[3] or "")]
            if len(own) < min_group:
                own = [x for x in good if (x[0][2] or "") == (r[2] or "")]
            if len(own) < min_group:
                own = good
            values = sorted(plain_bucket(value(rule, x)) for _, x in own)
            low, high = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            spread = rule.reach * max(high - low, rule.least)
            kept &= value(rule, m) <= high + spread
            if rule.both_sides:
                kept &= value(rule, m) >= low - spread
        out.append((r[0], *m, failed(m), kept))
    return out


def mixed_rows():
    import random

    rng = random.Random(8)
    rows = odd_rows(plain=10)
    for k in range(200, 330):
        text = sentence(rng, rng.randint(40, 120))
        if k % 9 == 0:
            text = " ".join(w + "***" for w in text.split())
        if k % 13 == 0:
            text = text.replace(" ", "\n") + "\nan\nan\nan\nan\nan\nan\nan"
        rows.append((k, text, "en" if k % 4 else "de", f"s{k % 2}", 1, None, None, None))
    return rows


def test_verdicts_equal_a_plain_version(spark, monkeypatch):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = plain_verdicts(rows, quality.MIN_GROUP)
    assert {r[-1] for r in expected if not r[-2]} == {True, False}
    for limit in (quality.BROADCAST_ROWS, 0):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", limit)
        found = [tuple(r) for r in quality.judge(docs).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_keep_good_keeps_all_columns_of_the_same_rows(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    verdict = [v[-1] for v in plain_verdicts(rows, quality.MIN_GROUP)]
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(r) for r, v in zip(rows, verdict) if v)


def test_merged_sketches_are_the_sketch_of_all(spark):
    docs = odd_docs(spark).selectExpr("doc_id", "text", "lang", "source")
    measured = quality.with_measures(docs, "text", "")
    whole = quality.sketch(measured, "lang", "source")
    parts = [quality.sketch(measured.where(f"coalesce(doc_id, 0) % 2 = {k}"), "lang", "source") for k in (0, 1)]
    keys = ["lang", "source", "rule", "bucket"]
    merged = parts[0].unionByName(parts[1]).groupBy(*keys).sum("n")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.select(*keys, "n").collect()))


def test_empty_table(spark):
    assert quality.judge(no_docs(spark)).count() == 0
    assert quality.keep_good(no_docs(spark)).count() == 0
