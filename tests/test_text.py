"""Column expressions against values worked out by hand."""

import hashlib

from pyspark.sql import functions as F

from varlex.functions import text as X
from varlex.functions import vectors as V


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_composite_text_golden(spark):
    df = one(spark, source_dataset="NHANES", variable_name="BMXBMI",
             description="Body Mass Index (kg/m**2) calculated for selected age ranges.")
    assert value(df, X.composite_text()) == (
        "NHANES | bmxbmi | body mass index kgm2 calculated for selected age ranges"
    )


def test_composite_text_skips_nulls(spark):
    df = spark.createDataFrame([("S", None, "A b")], "source_dataset string, variable_name string, description string")
    assert value(df, X.composite_text()) == "S | a b"


def test_trim_keeps_tabs_and_strip_removes_them(spark):
    df = one(spark, t="\t Name \t")
    assert value(df, X.clean_name("t")) == "\t name \t"
    assert value(df, X.strip_whitespace("t")) == "Name"


def test_demographics(spark):
    tags = lambda q: value(one(spark, q=q), X.demographic_tags("q"))
    assert tags("Find cardiovascular metrics and body mass index tracking for adults over 50") == ["Adult/Mature"]
    assert tags("measurement of youth, well managed") == ["Adult/Mature", "Pediatric", "Gender-Specific"]
    assert tags("blood pressure") == []
    assert tags("FEMALE") == ["Gender-Specific"]


def test_keywords(spark):
    got = value(one(spark, q="Show me the Glucose, the glucose and BMI!"), X.extract_keywords("q"))
    assert got == ["bmi", "glucose"]


def test_routes(spark):
    route = lambda s: value(one(spark, s=s), X.route_source("s"))
    assert [route(s) for s in ("who_gho", "USAID_DHS", "cdc_nhanes", "mimic_iv")] == ["WHO", "DHS", "NHANES", None]
    assert route("whole_nhanes_dhs") == "WHO"
    table = lambda t: spark.createDataFrame([(t,)], "t string").select(X.route_table("t")).first()[0]
    assert [table(t) for t in ("bmx_j", "", "N/A", None)] == ["BMX_J", "DEMO_J", "DEMO_J", "DEMO_J"]


def test_truthiness_and_key_presence(spark):
    df = spark.createDataFrame([("", None, "7")], "a string, b string, c string")
    assert value(df, X.first_truthy("a", "b", "c")) == "7"
    m = spark.range(1).select(F.create_map(F.lit("field_id"), F.lit("")).alias("m"))
    assert value(m, X.resolve_keys("m", ("field_id", "label"), "N/A")) == ""
    assert value(m, X.resolve_keys("m", ("label",), "N/A")) == "N/A"


def test_template_with_alternatives_and_null(spark):
    df = spark.createDataFrame([("x", "", None)], "Label string, Definition string, Unit string")
    assert value(df, X.render("L {Label} D {Definition or Label} U {Unit}")) == "L x D x U None"


def test_seed(spark):
    assert value(one(spark, t="Diabetes mellitus diagnosis"), V.text_seed("t")) == 343095768
    text = "é – ü"
    expected = int(hashlib.sha256(text.encode()).hexdigest(), 16) % 2**32
    assert value(one(spark, t=text), V.text_seed("t")) == expected
