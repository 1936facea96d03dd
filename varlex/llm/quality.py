"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from varlex.llm.common import documents, durable, forget_others, inputs

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """An integer measure and how far from the middle half of its group a document may lie.

    The range is ``low - reach * spread`` to ``high + reach * spread``, where
    low and high are the group's quartiles and spread is their distance, but
    at least ``least`` units of the measure.
    """

    name: str
    scale: int
    above: str
    below: str
    reach: int
    least: int
    both_sides: bool = False


# Per thousand characters or words; word length in hundredths of a character.
RULES = (
    Rule("symbols", 1000, "n_symbols", "word_chars", 4, 20),
    Rule("lines", 1000, "n_dup_lines", "n_words", 4, 10),
    Rule("repeats", 1000, "n_repeat_words", "n_words", 4, 60),
    Rule("length", 100, "word_chars", "n_words", 4, 60, both_sides=True),
)
# Groups with fewer documents take the merged sketch of their language, or of all.
MIN_GROUP = 100
# Values below 2 ** (KEPT_BITS + 1) are exact; larger ones keep this many bits after the leading one.
KEPT_BITS = 5
# Threshold rows up to this number are broadcast (about 60 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text."""
    total = len(words) - window + 1
    if total < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key = ids[:total]
    for k in range(1, window):
        # Renumbered before each step, so that keys stay below the square of the word count.
        if k > 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(numbers) + ids[k : k + total]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    if not repeated.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + total] |= repeated
    return int(covered.sum())


def measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = np.frombuffer(text, np.uint8)
    # Code points start at bytes that don't continue one; white space is ASCII here.
    points = int(np.count_nonzero((chars & 0xC0) != 0x80))
    blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line.strip():
            seen.add(line)
    symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    return len(words), points - blanks, symbols, duplicates, repeated_words(words)


def with_measures(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """All rows and columns with the measures of a text column behind them."""
    names = [prefix + m for m in MEASURES]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            found = np.array([measures(t) for t in texts], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(found[:, k].copy(), pa.int64()) for k in range(len(names)))],
                [*batch.schema.names, *names],
            )

    schema = StructType([*rows.schema.fields, *(StructField(name, LongType()) for name in names)])
    return rows.mapInArrow(scan, schema)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def values(prefix: str = "") -> dict[str, Column]:
    """Each rule's value, for rows with a word."""
    return {
        r.name: F.expr(f"{r.scale} * `{prefix}{r.above}` div nullif(`{prefix}{r.below}`, 0)") for r in RULES
    }


def bucket(value: Column) -> Column:
    """Lower bound of the sketch's bucket: a relative error below 1 / 2 ** KEPT_BITS."""
    drop = F.greatest(F.length(F.bin(value)) - 1 - KEPT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(rows: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """Mergeable quantile sketches: (lang, source, rule, bucket, n).

    A sketch is a histogram with logarithmic buckets; adding counts merges
    two of them exactly, in any order.  Counts are combined before they are
    shuffled, and a group has at most a few hundred buckets for each rule.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), bucket(v).alias("bucket")) for k, v in values(prefix).items()])
    return (
        rows.where(~base_failed(prefix))
        .select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"),
                F.explode(pairs).alias("v"))
        .groupBy("lang", "source", F.col("v.rule").alias("rule"), F.col("v.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the merged sketches of each group: the buckets in which they lie."""
    by = [*keys, "rule"]
    merged = sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    over = ", ".join(by)
    return (
        merged.withColumn("upto", F.expr(f"sum(n) over (partition by {over} order by bucket)"))
        .withColumn("total", F.expr(f"sum(n) over (partition by {over})"))
        .groupBy(*by)
        .agg(
            F.max("total").alias("total"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("low"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("high"),
        )
    )


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, and for each rule its least and greatest value) for every group.

    A group's own sketch counts if it has ``min_group`` documents; else the
    merged sketch of its language; else that of all documents.
    """
    own = quartiles(sketches, ["lang", "source"])
    of_lang = quartiles(sketches, ["lang"]).select(
        "lang", "rule", *[F.col(c).alias(f"lang_{c}") for c in ("total", "low", "high")]
    )
    of_all = quartiles(sketches, []).select("rule", *[F.col(c).alias(f"all_{c}") for c in ("low", "high")])
    joined = own.join(of_lang, ["lang", "rule"]).join(of_all, "rule")

    def chosen(c: str) -> Column:
        return (
            F.when(F.col("total") >= min_group, F.col(c))
            .when(F.col("lang_total") >= min_group, F.col(f"lang_{c}"))
            .otherwise(F.col(f"all_{c}"))
        )

    ranges = joined.select("lang", "source", "rule", chosen("low").alias("low"), chosen("high").alias("high"))
    columns = []
    for rule in RULES:
        spread = F.greatest(F.col("high") - F.col("low"), F.lit(rule.least)) * rule.reach
        here = F.col("rule") == rule.name
        columns.append(F.max(F.when(here, F.col("high") + spread)).alias(f"{rule.name}_most"))
        if rule.both_sides:
            columns.append(F.max(F.when(here, F.col("low") - spread)).alias(f"{rule.name}_least"))
    return ranges.groupBy("lang", "source").agg(*columns)


def _verdict(rows: DataFrame, limits: DataFrame, lang: str, source: str, prefix: str) -> DataFrame:
    """Rows joined with their group's limits, and the verdict as ``<prefix>kept``."""
    limits = durable(limits)
    named = limits.select(*[F.col(c).alias(f"{prefix}limit_{c}") for c in limits.columns])
    if limits.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    keys = [
        F.coalesce(F.col(f"`{name}`"), F.lit("")) == F.col(f"{prefix}limit_{key}")
        for name, key in ((lang, "lang"), (source, "source"))
    ]
    joined = rows.join(named, keys, "left")
    inside = ~base_failed(prefix)
    for rule, value in values(prefix).items():
        inside &= value <= F.col(f"{prefix}limit_{rule}_most")
        if next(r for r in RULES if r.name == rule).both_sides:
            inside &= value >= F.col(f"{prefix}limit_{rule}_least")
    return joined.withColumn(f"{prefix}kept", F.when(base_failed(prefix), False).otherwise(inside))


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(doc_id, the measures, base_failed, kept) for every row of ``docs``.

    A document is kept if it passes the base rules and every measure lies in
    the range that its language and source usually have.  Only documents that
    pass the base rules enter the sketches.  A null or empty text has no words
    and fails; a null language or source counts as an empty one; repeated rows
    count as often as they come; texts are read whole; other columns are not
    read; an empty table gives no rows.
    """
    rows = inputs(docs, doc_id=doc_id, text=text, lang=lang, source=source)
    measured = durable(
        with_measures(rows, "text", "").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", *MEASURES)
    )
    limits = thresholds(durable(sketch(measured, "lang", "source")))
    judged = _verdict(measured, limits, "lang", "source", "")
    return judged.select("doc_id", *MEASURES, base_failed().alias("base_failed"), "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Measures are taken twice, for the sketches and for the verdict, rather
    than writing the texts in between.
    """
    prefix = "_q"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows = inputs(docs, text=text, lang=lang, source=source)
    limits = thresholds(durable(sketch(with_measures(rows, "text", ""), "lang", "source")))
    judged = _verdict(with_measures(docs, text, prefix), limits, lang, source, prefix)
    return judged.where(f"{prefix}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def _sql() -> str:
    """The same for DuckDB, from words, lines and windows as rows."""
    measured = [(r, f"({r.scale} * {r.above} // {r.below})") for r in RULES]
    union = "\n  union all ".join(
        f"select coalesce(lang, '') as lang, coalesce(source, '') as source, '{r.name}' as rule, {e} as v "
        "from measured where not base_failed"
        for r, e in measured
    )
    drop = f"greatest(length(bin(v)) - 1 - {KEPT_BITS}, 0)"

    def quartile(name: str, keys: str) -> str:
        by = f"{keys}, rule" if keys else "rule"
        return f"""{name} as (
  select {by}, max(total) as total,
    min(case when upto * 4 >= total then bucket end) as low,
    min(case when upto * 4 >= total * 3 then bucket end) as high
  from (select {by}, bucket, sum(n) over (partition by {by} order by bucket) as upto,
          sum(n) over (partition by {by}) as total
        from (select {by}, bucket, sum(n) as n from sketches group by {by}, bucket))
  group by {by})"""

    def pick(c: str) -> str:
        return (
            f"case when o.total >= {MIN_GROUP} then o.{c} when l.total >= {MIN_GROUP} then l.{c} else a.{c} end as {c}"
        )

    checks = []
    for r, e in measured:
        spread = f"{r.reach} * greatest(high - low, {r.least})"
        of = f"(select {{}} from limits t where t.lang = coalesce(m.lang, '') and t.source = coalesce(m.source, '') and t.rule = '{r.name}')"
        checks.append(f"{e} <= {of.format(f'high + {spread}')}")
        if r.both_sides:
            checks.append(f"{e} >= {of.format(f'low - {spread}')}")
    word = r"[^\x20\x09-\x0D]+"
    return f"""
with d as (select row_number() over () as row_no, doc_id, lang, source, coalesce(text, '') as text from documents),
words as (
  select row_no, generate_subscripts(w, 1) as pos, unnest(w) as word
  from (select row_no, regexp_extract_all(text, '{word}') as w from d)),
windows as (
  select row_no, pos, word, lead(word, 1) over s as second, lead(word, 2) over s as third
  from words window s as (partition by row_no order by pos)),
counted as (
  select row_no, pos, count(*) over (partition by row_no, word, second, third) as n
  from windows where third is not null),
repeats as (
  select row_no, count(distinct pos + k) as n_repeat_words
  from counted, (select unnest([0, 1, 2]) as k) where n > 1 group by row_no),
sizes as (select row_no, count(*) as n_words, sum(length(word)) as word_chars from words group by row_no),
lines as (
  select row_no, sum(n - 1) as n_dup_lines
  from (select row_no, line, count(*) as n
        from (select row_no, unnest(string_split(text, chr(10))) as line from d)
        where regexp_matches(line, '{word}') group by row_no, line)
  group by row_no),
measured as (
  select *, n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} as base_failed
  from (select doc_id, lang, source, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
          cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
          cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
        from d left join sizes using (row_no) left join lines using (row_no) left join repeats using (row_no))),
rated as ({union}),
sketches as (
  select lang, source, rule, bucket, count(*) as n
  from (select lang, source, rule, (v >> {drop}) << {drop} as bucket from rated)
  group by lang, source, rule, bucket),
{quartile("own", "lang, source")},
{quartile("of_lang", "lang")},
{quartile("of_all", "")},
limits as (
  select o.lang, o.source, o.rule, {pick("low")}, {pick("high")}
  from own o join of_lang l on o.lang = l.lang and o.rule = l.rule join of_all a on o.rule = a.rule)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when base_failed then false else {" and ".join(checks)} end as kept
from measured m
"""


OP7_SQL = _sql()
