"""The pipeline's stages: columns, effect of every stage, odd rows and empty tables."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from fixtures import SCHEMA, no_docs, odd_rows, sentence
from varlex.llm import bpe_replay, line_dedup
from varlex.llm.common import BoundedCache

ITEM = sentence(random.Random(50), 30)


def corpus():
    rng = random.Random(12)
    long = lambda: ". ".join(sentence(rng, 12) for _ in range(10))
    shared = sentence(rng, 60)
    rows = odd_rows()
    rows += [(k, long(), "en", "s0", 1, None, None, None) for k in range(500, 540)]
    rows += [
        (600, f"{long()}\n{shared}", "en", "s0", 1, None, None, None),
        (601, f"{shared}\n{long()}", "en", "s0", 1, None, None, None),
        (602, f"{long()} {ITEM} {long()}", "en", "s0", 1, None, None, None),
        (603, " ".join(w + "###" for w in long().split()), "en", "s0", 1, None, None, None),
        (604, rows[-1][1], "en", "s0", 1, None, None, None),
    ]
    return rows, shared


def test_every_stage_takes_effect(spark, tmp_path):
    rows, shared = corpus()
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding",
    ]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert docs.columns == columns
            left[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in found} for name, found in left.items()}
    assert {100, 101, 102, 603}.isdisjoint(ids["quality_rules"]) and {500, 600, 601, 602} <= ids["quality_rules"]
    texts = [r["text"] for r in left["line_dedup"]]
    assert sum(shared in t for t in texts) == 1 and {600, 601} <= ids["line_dedup"]
    # A copy whose lines all went has gone with them.
    assert len(ids["near_dedup"] & {539, 604}) == 1
    assert 602 in ids["near_dedup"] and 602 not in ids["decontamination"]
    assert set(range(500, 539)) <= ids["decontamination"]
    vocab = bpe_replay.vocabulary(*bpe_replay.production_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    counts = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert counts == {r["doc_id"]: len(library.encode_ordinary(r["text"])) for r in left["decontamination"]}


def test_line_stage_links_by_simhash_and_by_edits(spark):
    """A line without a common 8-gram, whose SimHash is the same, goes like one with a changed word and far SimHash."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    seldom = [rng.choice(letters) + rng.choice(letters) for _ in range(40)]
    first = "of " + " ".join(f"{w} of" for w in seldom)
    second = "of " + " ".join(f"{w[0]}{rng.choice('0123456789')} of" for w in seldom)
    grams = [{t[k : k + line_dedup.GRAM] for k in range(len(t) - line_dedup.GRAM + 1)} for t in (first, second)]
    assert not grams[0] & grams[1] and line_dedup.similar(first, second)
    words = sentence(rng, 12).split(" ")
    third, fourth = " ".join(words), " ".join([*words[:5], "xq", *words[6:]])
    prints = line_dedup.simhashes([t.split(" ") for t in (first, second, third, fourth)], BoundedCache()).tolist()
    assert prints[0] == prints[1] and (prints[2] ^ prints[3]).bit_count() > 3 and line_dedup.similar(third, fourth)
    kept = [f"Kept {k} {sentence(rng, 9)}" for k in range(4)]
    rows = [(k, f"{text}\n{kept[k]}", "en", "s", 1, None, None, None) for k, text in enumerate((first, second, third, fourth))]
    found = corpus_pipeline.fuzzy_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r["doc_id"]: r["text"] for r in found} == {0: rows[0][1], 1: kept[1], 2: rows[2][1], 3: kept[3]}


def test_an_empty_table_stays_empty(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = no_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
