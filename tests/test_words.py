"""Gazetteer entities and BM25 scores against plain Python."""

import math
import random
import re

import pytest

from varlex.operators import gazetteer, postings
from varlex.session import fresh_path

BREAK = re.compile(r"[^\W_]+")


def split(text):
    return BREAK.findall((text or "").lower())


def entities(text, names):
    known = {}
    for name, label, meaning in names:
        words = tuple(split(name))
        if words:
            entry = (label or "", meaning or "")
            known[words] = min(known.get(words, entry), entry)
    words, found, at = split(text), [], 0
    while at < len(words):
        for n in range(len(words) - at, 0, -1):
            if tuple(words[at : at + n]) in known:
                found.append((" ".join(words[at : at + n]), *known[tuple(words[at : at + n])]))
                at += n
                break
        else:
            at += 1
    return found


def random_texts(rng, count, most):
    return [" ".join(rng.choice("ab c d, E. f-g".split(" ")) for _ in range(rng.randint(0, most))) for _ in range(count)]


def test_longest_names_from_the_left(spark):
    rng = random.Random(2)
    names = [(t, rng.choice("xy"), rng.choice("pq")) for t in random_texts(rng, 40, 4)]
    names += [("Body-Mass index", "L", "bmi"), ("body mass", "L", "bm"), ("BODY MASS INDEX", "A", "bmi2"), ("  ", "L", "none")]
    texts = random_texts(rng, 300, 25) + [None, "", "...", "the body mass, index; body mass", "mass index", "body mass index " * 200]
    texts += texts[:20]
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id long, query string").repartition(3)
    given = spark.createDataFrame(names, "name string, label string, meaning string")
    found = gazetteer.link_entities(queries, given).collect()
    assert len(found) == len(texts)
    for row in found:
        assert [tuple(e) for e in row["named_entities"]] == entities(texts[row["query_id"]], names), texts[row["query_id"]]
    annotated = gazetteer.annotate_with_names(queries, given)
    assert annotated.columns == ["query_id", "query", "original_query", "extracted_keywords", "named_entities", "inferred_demographics"]
    assert annotated.count() == len(texts)


def test_without_names(spark):
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    nothing = spark.createDataFrame([], "name string, label string, meaning string")
    assert gazetteer.link_entities(queries, nothing).first()["named_entities"] == []


def test_places_are_not_moved_to_find_names(spark):
    names = spark.createDataFrame(
        [("a b c", "X", "1"), ("a", "X", "2"), ("b", "X", "3"), ("c d", "X", "4"), ("d e f g", "X", "5")], "name string, label string, meaning string"
    )
    queries = spark.createDataFrame([(1, "a b c d"), (2, "a b a c d e"), (3, "d e f d e f g"), (4, "z")], "query_id long, query string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = gazetteer.link_entities(queries, names)
        assert "hashpartitioning(first" not in linked._jdf.queryExecution().executedPlan().toString()
        found = {r["query_id"]: [e["meaning"] for e in r["named_entities"]] for r in linked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {1: ["1"], 2: ["2", "3", "2", "4"], 3: ["5"], 4: []}


def plain_bm25(query, doc, docs):
    lengths = {k: len(split(t)) for k, t in docs.items()}
    average = sum(lengths.values()) / len(docs)
    total = 0.0
    for term in set(split(query)):
        df = sum(term in split(t) for t in docs.values())
        tf = split(docs[doc]).count(term)
        if tf:
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            total += round(idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * lengths[doc] / average)), 6)
    return total


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(7)
    path = fresh_path(spark, "test-postings")
    docs = {}
    for batch in range(3):
        some = {f"d{rng.randrange(60)}": t for t in random_texts(rng, 40, 30)}
        some[f"d{batch}"] = None if batch == 1 else ""
        docs |= some
        rows = spark.createDataFrame(list(some.items()), "id string, document string").repartition(2)
        assert postings.add_documents(spark, rows, path, buckets=4) == batch + 1
    return path, docs


def test_statistics_are_those_of_the_current_documents(spark, indexed):
    path, docs = indexed
    expected = {}
    for text in docs.values():
        for term in set(split(text)):
            expected[term] = expected.get(term, 0) + 1
    assert {r["term"]: r["df"] for r in postings.term_statistics(spark, path).collect()} == expected
    assert {r["id"]: r["length"] for r in postings.stored_documents(spark, path).collect()} == {k: len(split(t)) for k, t in docs.items()}


def test_scores_and_ranks(spark, indexed):
    path, docs = indexed
    asked = {1: "a c, c. zzz", 2: "E f", 3: "", 4: "nothing here"}
    names = [*sorted(docs), "absent"]
    rows = [(q, t, name, place) for q, t in asked.items() for place, name in enumerate(names, 1)]
    candidates = spark.createDataFrame(rows, "query_id long, query string, id string, vector_rank int")
    found = postings.bm25_rerank(spark, candidates, path, buckets=4).collect()
    assert len(found) == len(rows)
    for q, text in asked.items():
        own = {r["id"]: r for r in found if r["query_id"] == q}
        scores = {n: plain_bm25(text, n, docs) if n in docs else 0.0 for n in names}
        assert all(abs(own[n]["rerank_score"] - scores[n]) < 2e-6 for n in names)
        ranked = sorted(own.values(), key=lambda r: (-r["rerank_score"], r["vector_rank"]))
        assert [r["final_rank"] for r in ranked] == list(range(1, len(names) + 1))


def test_a_repeated_batch_changes_nothing(spark, indexed):
    path, docs = indexed
    before = {tuple(r) for r in postings.term_statistics(spark, path).collect()}
    rows = spark.createDataFrame([("d3", "a b"), ("new", "zzz")], "id string, document string")
    number = postings.add_documents(spark, rows, path, buckets=4)
    once = {tuple(r) for r in postings.term_statistics(spark, path).collect()}
    assert postings.add_documents(spark, rows, path, buckets=4, batch=number) == number
    assert {tuple(r) for r in postings.term_statistics(spark, path).collect()} == once != before


def test_only_buckets_of_the_query_are_read(spark, indexed):
    path, _ = indexed
    candidates = spark.createDataFrame([(1, "c", "d3")], "query_id long, query string, id string")
    plan = postings.bm25_scores(spark, candidates, path, buckets=4)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert any("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in filters)
