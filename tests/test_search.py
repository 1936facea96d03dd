"""Rerank, search, context and query annotation."""

from pyspark.sql import functions as F

from varlex.operators import context
from varlex.operators.annotate import annotate_queries
from varlex.operators.embed import add_hash_vector
from varlex.operators.rerank import keep_best, rerank
from varlex.plans.search import embed_queries, search, source_filter

CANDIDATES = "query_id long, query string, vector_rank int, source_dataset string, variable_name string, description string"


def smoke(spark):
    return spark.createDataFrame(
        [
            (1, "body mass index metrics", 1, "NHANES", "RIAGENDR", "Gender of the participant. 1=Male, 2=Female."),
            (1, "body mass index metrics", 2, "UK_Biobank", "f.21001",
             "Anthropometric measurement of body weight divided by squared height (BMI)."),
            (1, "body mass index metrics", 3, "x", "y", None),
        ],
        CANDIDATES,
    )


def test_rerank_is_a_stable_permutation(spark):
    rows = rerank(smoke(spark)).orderBy("final_rank").collect()
    assert [r["vector_rank"] for r in rows] == [2, 1, 3]
    assert [r["rerank_score"] for r in rows] == [0.25, 0.0, 0.0]
    assert rerank(smoke(spark).limit(0)).count() == 0


def test_scorer_hook_sees_pairs(spark):
    def factory():
        return lambda queries, texts: [float(len(t)) for t in texts]

    rows = rerank(smoke(spark), scorer=factory).orderBy("final_rank").collect()
    assert rows[-1]["rerank_score"] == len("x | y | ")
    assert rows[0]["rerank_score"] > rows[1]["rerank_score"] > rows[2]["rerank_score"]


def corpus(spark):
    rows = [(f"id{i}", f"s{i % 3}" if i % 7 else None, f"c{i}", f"document number {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, source string, indicator_id string, document string")
    meta = F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source"))).otherwise(
        F.create_map(F.lit("title"), F.lit("t")))
    return add_hash_vector(df.withColumn("metadata", meta))


def test_search_finds_identical_text_first(spark):
    queries = spark.createDataFrame([(i, f"document number {i}") for i in range(8)], "query_id long, query string")
    found = search(embed_queries(queries), corpus(spark), n=3, max_dist=4.0)
    rows = found.collect()
    assert len(rows) == 24
    nearest = {r["query_id"]: r for r in rows if r["distance"] < 0.001}
    assert {q: r["id"] for q, r in nearest.items()} == {i: f"id{i}" for i in range(8)}
    assert all(r["variable_id"] == f"c{q}" and r["vector_rank"] == 1 for q, r in nearest.items())
    assert nearest[0]["source_dataset"] == "unknown" and nearest[1]["source_dataset"] == "s1"
    for q in range(8):
        assert sorted(r["final_rank"] for r in rows if r["query_id"] == q) == [1, 2, 3]


def test_threshold_may_leave_fewer_than_n(spark):
    queries = embed_queries(spark.createDataFrame([(1, "document number 4"), (2, "other")], "query_id long, query string"))
    rows = search(queries, corpus(spark), n=5, max_dist=0.5).collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(1, "id4")]


def test_per_query_sources_and_sizes(spark):
    data = [(1, "document number 4", ["s1"], 2), (2, "document number 7", [], 10),
            (3, "document number 7", ["s0", "s1", "s2", "unknown"], 1)]
    queries = embed_queries(spark.createDataFrame(data, "query_id long, query string, sources array<string>, n int"))
    rows = search(queries, corpus(spark), max_dist=9.0).collect()
    per = {q: [r for r in rows if r["query_id"] == q] for q in (1, 2, 3)}
    assert [len(per[q]) for q in (1, 2, 3)] == [2, 10, 1]
    assert {r["source_dataset"] for r in per[1]} == {"s1"}
    assert any(r["id"] == "id7" for r in per[2])  # no source, survives "none selected"


def test_source_filter(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(source_filter("s", 2)).collect()] == [None, ["a"], None, None]


def test_context_and_prompt(spark):
    matches = spark.createDataFrame(
        [(1, 2, "s", "B", "two"), (1, 1, None, "A", "one"), (1, 3, "s", "", None)],
        "query_id long, final_rank int, source_dataset string, variable_id string, description string",
    ).withColumn("table_id", F.lit(None).cast("string"))
    block = context.context_block(matches)
    assert block.first()["context"] == (
        "[Match #1 | Source: N/A | Code: A]\none\n\n[Match #2 | Source: s | Code: B]\ntwo\n\n[Match #3 | Source: s | Code: ]\n"
    )
    assert context.target_ids(matches).first()["target_ids"] == ["A", "B"]
    assert context.export_records(matches).where("final_rank = 3").first()["description"] == ""
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, query string")
    prompts = {r["query_id"]: r for r in context.build_prompt(queries, block, "test registers").collect()}
    assert prompts[2]["user_prompt"] == "Context Blocks:\n\n\nUser Question: q2"
    assert "current test registers." in prompts[1]["system_prompt"]


def test_annotator_hook(spark):
    def factory():
        return lambda texts: [(["b", "a", "b"], [("2019", "DATE", "dates")]) for _ in texts]

    queries = spark.createDataFrame([("children in 2019",)], "query string")
    row = annotate_queries(queries, factory).first()
    assert row["extracted_keywords"] == ["a", "b"]
    assert row["named_entities"][0]["label"] == "DATE"
    assert row["inferred_demographics"] == ["Pediatric"]
    plain = annotate_queries(queries).first()
    assert plain["named_entities"] == [] and plain["extracted_keywords"] == ["2019", "children"]


def test_keep_best_by_column(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 2)], "query_id int, final_rank int, n int")
    assert keep_best(df, "n").count() == 3 and keep_best(df, 1).count() == 2
