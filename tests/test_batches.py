"""Dictionaries of mixed files, and row numbers that go on over batches."""

import json

import pytest
from pyspark.sql import functions as F

from varlex.operators import ordering as O
from varlex.operators.ordering import ORD
from varlex.operators.row_ledger import RowLedger
from varlex.plans.ingest import run_ingest
from varlex.sources import dictionaries as D
from varlex.sources.files import scan_csv
from varlex.sources.stores import scan_vector_store
from varlex.specs import MODEL_SPECS
from varlex.streaming.landing import landing_stream, upsert_stream

NAMES = ["Code", "Name"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "landed files"
    (path / "sub").mkdir(parents=True)
    (path / "a.csv").write_text('Code,Name\n1,"one, ""1"""\n2,"two\nlines"\n3,N/A\n\n4,x,y,z\n5\n')
    (path / "b.csv").write_text("\ufeffOther,Name,Code\no,six,6\n")
    (path / "c.tsv").write_text("Name\tCode\nseven, too\t7\n")
    (path / "sub" / "d.json").write_text(json.dumps({"value": [{"Code": 8, "Name": None}, 5, {"Name": [1, "é"], "Code": "9"}]}))
    (path / "e.json").write_text(json.dumps([{"Code": "10", "Name": "ten"}]))
    (path / "f.txt").write_text("{Code,Name\n{11,x\n")
    (path / "g.csv").write_text("nothing,here\n1,2\n")
    (path / "empty.csv").write_text("")
    (path / "_SUCCESS").write_text("skipped")
    return path


def test_files_of_a_folder_settle_their_own_format_and_header(spark, folder):
    read = D.read_dictionary(spark, str(folder), NAMES, key="value")
    assert rows(read.where("_problem is null")) == sorted([
        ("1", 'one, "1"'), ("2", "two\nlines"), ("3", None), ("5", None), ("6", "six"), ("7", "seven, too"),
        ("8", None), ("9", '["1", "é"]'), ("10", "ten"), (None, "x"),
    ], key=str)
    bad = {(r["file"].rsplit("/", 1)[1], r["problem"]): r["rows"] for r in D.bad_rows(read).collect()}
    assert bad == {
        ("a.csv", "more fields than the header"): 1, ("d.json", "not an object"): 1, ("g.csv", "no known column in the header"): 1,
    }
    assert read.rdd.getNumPartitions() == 7


def test_planning_runs_no_job(spark, folder):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    D.scan_dictionary(spark, str(folder), NAMES).explain()
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_byte_ranges_read_every_line_once(spark, tmp_path, size):
    path = tmp_path / "long.csv"
    path.write_text("Name,Code\n" + "".join(f"né {k},{k}\n" for k in range(60)))
    read = D.scan_dictionary(spark, str(path), NAMES, fmt="csv", range_bytes=size, one_line_records=True)
    assert rows(read) == sorted(((str(k), f"né {k}") for k in range(60)), key=str)
    ragged = tmp_path / "ragged"
    ragged.write_text("Code  Name\n" + "".join(f"{k}\tx y\n" for k in range(20)) + "1  2  3\n9\n")
    read = D.scan_dictionary(spark, str(ragged), NAMES, fmt="ragged", range_bytes=size, one_line_records=True)
    assert rows(read) == sorted([*((str(k), "x y") for k in range(20)), ("9", None)], key=str)


def test_no_files_and_no_folder(spark, tmp_path):
    (tmp_path / "nothing").mkdir()
    assert D.scan_dictionary(spark, str(tmp_path / "nothing"), NAMES).count() == 0
    with pytest.raises(Exception, match="absent"):
        D.scan_dictionary(spark, str(tmp_path / "absent"), NAMES).count()


def test_null_orders_are_numbered_last(spark):
    df = spark.createDataFrame([(5,), (None,), (1,)], f"{ORD} long")
    found = {r[ORD]: r["row_index"] for r in O.row_index(df).collect()}
    assert found == {1: 0, 5: 1, None: 2}


def test_scan_numbers_move_no_rows(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(500).select(F.format_string("%05d", "id").alias("value")).repartitionByRange(6, "value").sortWithinPartitions(
        "value").write.text(path)
    numbered = O.scan_row_index(O.with_scan_order(spark.read.text(path)))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    rows_side = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in rows_side and "BroadcastHashJoin" in rows_side
    assert all(int(r["value"]) == r["row_index"] for r in numbered.collect())


def test_a_repeated_batch_keeps_its_numbers(spark, tmp_path):
    ledger = RowLedger(spark, str(tmp_path / "ledger"))
    assert (ledger.next_batch(), ledger.rows_before(0)) == (0, 0)
    ledger.commit(0, 3)
    ledger.commit(1, 4)
    ledger.commit(1, 4)
    ledger.commit(2, 5)
    assert (ledger.rows_before(1), ledger.rows_before(3), ledger.next_batch()) == (3, 12, 3)
    batch = spark.createDataFrame([(9, "b"), (2, "a")], f"{ORD} long, v string")
    assert {r["v"]: r["row_index"] for r in ledger.numbered(batch, 1).collect()} == {"a": 3, "b": 4}


def test_a_stream_keeps_the_rows_of_every_batch(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    spec = MODEL_SPECS["nih_allofus"]
    for texts in (["q1", "q2"], ["q3"], ["q4", "q5"]):
        spark.createDataFrame([(t,) for t in texts], "question_text string").coalesce(1).write.mode("append").json(landing)
        stream = landing_stream(spark, landing, "question_text string", "json")
        upsert_stream(stream, spec, store, checkpoint).awaitTermination()
    found = {r["id"]: r["document"] for r in scan_vector_store(spark, store).collect()}
    assert set(found) == {f"allofus_{k}" for k in range(5)}
    assert {d[-2:] for d in found.values()} == {"q1", "q2", "q3", "q4", "q5"}


def test_runs_over_different_landings_go_on_counting(spark, tmp_path):
    store = str(tmp_path / "store")
    for number, texts in enumerate((["q1", "q2"], ["q3"])):
        (tmp_path / f"{number}.csv").write_text("text\n" + "\n".join(texts) + "\n")
        report = run_ingest(
            spark, {"nih_allofus": lambda n=number: scan_csv(spark, str(tmp_path / f"{n}.csv"))}, MODEL_SPECS, store, ["nih_allofus"]
        ).first()
        assert report["status"] == "ok", report["error"]
    assert scan_vector_store(spark, store).count() == 3
