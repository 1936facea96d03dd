"""Small tables with every odd case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score string, kept string, fp string"


def sentence(rng: random.Random, words: int = 12) -> str:
    return " ".join("".join(rng.choice(("an", "ti", "ou", "re", "st")) for _ in range(rng.randint(1, 4))) for _ in range(words))


def odd_rows(seed: int = 1, plain: int = 30) -> list[tuple]:
    """Plain rows, null in every column, empty, blank and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(seed)
    rows = []
    for k in range(plain):
        text = ".\n".join(sentence(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 6)))
        rows.append((k, text, rng.choice(("en", "fr")), f"s{k % 3}", len(text), "x", "y", "z"))
    base = rows[3][1]
    long = "\n".join(sentence(rng, 20) for _ in range(400))
    rows += [
        (100, None, "en", "s0", None, None, None, None),
        (101, "", None, "s0", 0, None, None, None),
        (102, " \t\n\n ", "en", None, 5, None, None, None),
        (103, long, "fr", "s1", len(long), "", "", ""),
        (104, base, "en", "s1", 1, "", "", ""),
        (104, base, "en", "s1", 1, "", "", ""),
        (105, base.replace("an", "na", 1), None, None, 1, "", "", ""),
        (104, rows[5][1], "en", "s1", 1, "", "", ""),
        (None, base, "en", "s1", 1, "", "", ""),
        (None, None, None, None, None, None, None, None),
        (106, "É ﬁne 漢字 🙂 <|endoftext|> <s> a" + "b" * 300, "en", "s2", 9, "", "", ""),
    ]
    return rows


def odd_docs(spark, **options):
    return spark.createDataFrame(odd_rows(**options), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


class Groups:
    """Union-find."""

    def __init__(self):
        self.root: dict = {}

    def find(self, x):
        self.root.setdefault(x, x)
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        self.root[self.find(a)] = self.find(b)
