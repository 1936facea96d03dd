"""SimHash near-duplicates and connected components against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash

from fixtures import Groups, no_docs, odd_docs, odd_rows
from varlex.llm import simhash_trie
from varlex.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").translate({c: chr(c + 32) for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = odd_rows()
    found = simhash_trie.near_duplicates(odd_docs(spark)).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    groups = Groups()
    for a, b in combinations({p for _, p in prints}, 2):
        if (a ^ b).bit_count() <= 4:
            groups.join(a, b)
    lowest = {}
    for doc_id, p in prints:
        if doc_id is not None:
            g = groups.find(p)
            lowest[g] = min(lowest.get(g, doc_id), doc_id)
    expected = [(d, f"{p:016x}", lowest.get(groups.find(p))) for d, p in prints]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str) and key(expected[0])


def test_trie_pairs_equal_all_pairs():
    rng = random.Random(4)
    for budget in (0, 2, 4):
        groups, starts, ends = [], [], []
        for _ in range(5):
            centre = rng.getrandbits(64)
            own = {centre}
            for _ in range(40):
                own.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
            starts.append(len(groups))
            groups += sorted(own)
            ends.append(len(groups))
        fps = np.array(groups, np.uint64)
        found = set()
        for i, j in simhash_trie.trie_pairs(fps, np.array(starts), np.array(ends), budget):
            found |= set(zip(i.tolist(), j.tolist()))
        expected = {
            (i, j) for s, e in zip(starts, ends) for i, j in combinations(range(s, e), 2)
            if (groups[i] ^ groups[j]).bit_count() <= budget
        }
        assert found == expected


def test_large_groups_are_dealt_out_without_losing_links(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(63)
    values = {centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 6))) for _ in range(300)}
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    whole = Groups()
    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            whole.join(a, b)
    for group_rows in (4096, 20):
        groups = Groups()
        for a, b in simhash_trie.fingerprint_links(table, group_rows).collect():
            groups.join(a, b)
        assert {frozenset(v for v in values if groups.find(v) == groups.find(x)) for x in values} == {
            frozenset(v for v in values if whole.find(v) == whole.find(x)) for x in values
        }


def test_components_of_chains_stars_and_self_links(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    expected = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)} | {201: 200}
    assert found == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_leaves_one_row_of_each_component(spark):
    docs = odd_docs(spark)
    kept = simhash_trie.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    components = {(r[0], r[1]): r[2] for r in simhash_trie.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(r["text"]) for r in rows]
    assert all((a ^ b).bit_count() > 4 for a, b in combinations(prints, 2))
    ids = [r["doc_id"] for r in rows]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in components.values() if c is not None})
    assert simhash_trie.keep_one(no_docs(spark)).count() == 0


def test_empty_table(spark):
    assert simhash_trie.near_duplicates(no_docs(spark)).count() == 0
