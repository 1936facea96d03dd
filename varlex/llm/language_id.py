"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import chunked_matches, crc_mod, documents, durable, inputs, prepared
from varlex.session import discard, fresh_path

FOLDS, HELD_OUT = 4, 2
ORDER = 4
# Numbers (n-grams times languages) that are sent to every task as scores of frequent n-grams; words with any other
# n-gram are scored by joins, with the same result.
FREQUENT_CELLS = 4_000_000
# Words kept with their scores by each task, and the longest of them.
WORDS_KEPT, KEPT_CHARS = 200_000, 64
# A document is rejected if its cross-entropy is so many standard deviations above its language's mean.
REJECT_AT = 4.0
LEAST_DEVIATION = 0.02
# Nats per character that make one language e times as likely as another.
TEMPERATURE = 0.1
WORD = re.compile(r"[^\W\d_]+")
START, END = "^", "$"
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Words or characters that are cut into n-grams at a time.
CUT_WORDS, CUT_CHARS = 50_000, 2 << 20


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the highest order (one row of code points each) and how many each word has.

    A word is framed by start marks and one end mark; it has one n-gram for
    each of its characters and one for its end.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    pad = START * (ORDER - 1)
    text = "".join([f"{pad}{w}{END}" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    first = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)[first] if len(codes) else np.empty((0, ORDER), np.uint32), lengths


def hashed(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points; the width is part of it."""
    found = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        found = (found ^ grams[:, k]) * MULTIPLIER
        found ^= found >> np.uint64(31)
    return found


def _gathered(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[list]]:
    """The columns of several batches together, the first being words, about as many as are cut at a time."""
    held: list[list] = [[] for _ in columns]
    chars = 0
    for batch in batches:
        for into, name in zip(held, columns):
            into.extend(batch.column(name).to_pylist())
        chars += sum(map(len, held[0][-batch.num_rows :])) if batch.num_rows else 0
        if len(held[0]) > CUT_WORDS or chars > CUT_CHARS:
            yield held
            held, chars = [[] for _ in columns], 0
    if held[0]:
        yield held


def _gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of the highest order of all training texts, added up within each task first."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        words: dict[str, Counter] = {}

        def count() -> None:
            for lang, found in words.items():
                grams, lengths = windows(list(found))
                times = np.repeat(np.fromiter(found.values(), np.int64, len(found)), lengths)
                names = np.ascontiguousarray(grams).view(f"<U{ORDER}")[:, 0]
                different, where = np.unique(names, return_inverse=True)
                totals = np.bincount(where, times, len(different)).astype(np.int64)
                into = held.setdefault(lang, Counter())
                for gram, n in zip(different.tolist(), totals.tolist()):
                    into[gram] += n
            words.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                into = words.setdefault(lang, Counter())
                for found in chunked_matches(WORD, text.lower()):
                    into.update(found)
            if sum(map(len, words.values())) > 100_000:
                count()
            if sum(map(len, held.values())) > 500_000:
                yield from flush()
        count()
        yield from flush()

    counted = docs.select("lang", "text").mapInArrow(scan, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_tables(docs: DataFrame) -> DataFrame:
    """(lang, size, gram, n, total, types) of every order, from all training texts.

    Counts below the highest order are numbers of different characters in
    front; ``total`` and ``types`` belong to the context, of which no more
    n-grams than the alphabet has letters share one.
    """
    orders = [durable(_gram_counts(docs))]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.expr(f"substring(gram, 2, {order})").alias("gram")
        orders.append(orders[-1].select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    found = None
    for size, counts in zip(range(ORDER, 0, -1), orders):
        rows = counts.withColumn("context", F.expr(f"substring(gram, 1, {size - 1})"))
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        joined = rows.join(sums, ["lang", "context"]).select(
            "lang", F.lit(size).alias("size"), "gram", "n", "total", "types"
        )
        found = joined if found is None else found.unionByName(joined)
    return durable(found)


def _key(gram) -> Column:
    return F.xxhash64(gram)


@dataclass
class Models:
    """One interpolated model for each language, as a table in the shared folder.

    ``path`` holds, by ``size`` and kind, rows (key, values): the hash of an
    n-gram with its probabilities, or of a context with its back-off weights,
    by the language's place in ``languages``.  The files are sorted by hash,
    of any size, and go with ``close``.  ``unseen`` is what each language
    gives a character that it never met, before any weight; ``counted`` holds
    the n-grams of the highest order with their counts, language by language.
    """

    spark: SparkSession
    path: str
    languages: list[str]
    unseen: list[float]
    counted: DataFrame

    def _stored(self, size: int, kind: str, key: str, values: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where((F.col("size") == size) & (F.col("kind") == kind))
        return rows.select(F.col("key").alias(key), F.col("values").alias(values))

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, p) for every different ``gram`` of the highest order: P(last character | those before) by language.

        Each order's n-grams meet the stored hashes, their contexts' and the
        next lower order's results once; every join key is shared by no more
        rows than the alphabet has letters.
        """
        endings = F.explode(F.array(*[F.expr(f"substring(gram, {k})") for k in range(1, ORDER + 1)]))
        ends = durable(grams.select("gram").distinct().select(endings.alias("gram")).distinct())
        wanted = {size: ends.where(F.length("gram") == size) for size in range(1, ORDER + 1)}
        lower = None
        for size in range(1, ORDER + 1):
            rows = wanted[size].select(
                "gram", _key("gram").alias("_own"), _key(F.expr(f"substring(gram, 1, {size - 1})")).alias("_context")
            )
            rows = rows.join(self._stored(size, "p", "_own", "_p"), "_own", "left")
            rows = rows.join(self._stored(size, "weight", "_context", "_w"), "_context", "left")
            if lower is None:
                rows = rows.withColumn("_low", F.array(*[F.lit(x) for x in self.unseen]))
            else:
                below = lower.select(F.col("gram").alias("_suffix"), F.col("p").alias("_low"))
                rows = rows.withColumn("_suffix", F.expr("substring(gram, 2)")).join(below, "_suffix")
            lower = rows.select("gram", F.expr(
                "transform(_low, (x, i) -> coalesce(_p[i], coalesce(_w[i], 1D) * x))"
            ).alias("p"))
        return lower

    def words(self, words: DataFrame) -> DataFrame:
        """(key, sums, chars) for every different ``word``: logarithms of its probability by language, and its length.

        ``key`` is the word's 64-bit hash.  Very long words are whole, as
        their different n-grams with counts.
        """

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found, keys in _gathered(batches, ("word", "key")):
                codes, lengths = windows(found)
                grams = np.ascontiguousarray(codes).view(f"<U{ORDER}")[:, 0]
                different, where = np.unique(grams, return_inverse=True)
                owner = np.repeat(np.arange(len(found)), lengths)
                pairs, n = np.unique(owner * np.int64(len(different)) + where, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.int64)[pairs // len(different)]),
                     pa.array(different[pairs % len(different)].tolist(), pa.string()), pa.array(n.astype(np.int64))],
                    ["key", "gram", "n"],
                )

        path = fresh_path(self.spark, "language-grams")
        different = words.select("word").distinct().select("word", _key("word").alias("key"))
        different.mapInArrow(cut, "key long, gram string, n long").write.parquet(path)
        grams = self.spark.read.parquet(path)
        logs = self.probabilities(grams).select("gram", F.expr("transform(p, x -> ln(x))").alias("logs"))
        sums = [F.sum(F.col("n") * F.col("logs")[k]) for k in range(len(self.languages))]
        found = durable(grams.join(logs, "gram").groupBy("key").agg(F.array(*sums).alias("sums"), F.sum("n").alias("chars")))
        discard(self.spark, path)
        return found

    def close(self) -> None:
        discard(self.spark, self.path)


def train(docs: DataFrame) -> Models | None:
    """Models of all languages of ``docs`` (``lang``, ``text``, neither null); None without any word.

    P(c | h) = max(n - D, 0) / total + D * types / total * P(c | shorter h),
    with one discount D for each language and order.  Every n-gram of every
    language is kept; only discounts and the languages' names reach the driver.
    """
    spark = prepared(docs.sparkSession)
    tables = gram_tables(docs)
    found = tables.groupBy("lang", "size").agg(
        F.count("*").alias("grams"),
        F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"),
        F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("twice"),
    ).collect()
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    place = {name: k for k, name in enumerate(languages)}
    discounts = [
        (r["lang"], r["size"], place[r["lang"]], r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.75)
        for r in found
    ]
    unseen = [0.0] * len(languages)
    for r in found:
        if r["size"] == 1:
            unseen[place[r["lang"]]] = 1.0 / (r["grams"] + 2)
    fixed = spark.createDataFrame(discounts, "lang string, size int, place int, discount double")
    rows = (
        tables.join(F.broadcast(fixed), ["lang", "size"])
        .withColumn("weight", F.expr("discount * types / total"))
        .withColumn("own", F.expr("greatest(n - discount, 0D) / total"))
    )
    stored, lower = None, None
    for size in range(1, ORDER + 1):
        level = rows.where(F.col("size") == size)
        weights = level.select("place", F.expr(f"substring(gram, 1, {size - 1})").alias("gram"), F.col("weight").alias("value")).distinct()
        if lower is None:
            known = F.array(*[F.lit(x) for x in unseen])
            level = level.withColumn("low", known[F.col("place")])
        else:
            level = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(
                lower.select("place", F.col("gram").alias("suffix"), F.col("value").alias("low")), ["place", "suffix"]
            )
        p = level.select("place", "gram", F.expr("own + weight * low").alias("value"))
        if 1 < size < ORDER:
            p = durable(p)
        for kind, values in (("p", p), ("weight", weights)):
            part = values.select(F.lit(size).alias("size"), F.lit(kind).alias("kind"), "gram", "place", "value")
            stored = part if stored is None else stored.unionByName(part)
        lower = p
    path = fresh_path(spark, "language-models")
    entries = F.map_from_entries(F.collect_list(F.struct("place", "value")))
    (
        stored.groupBy("size", "kind", "gram").agg(entries.alias("values"))
        .select("size", "kind", _key("gram").alias("key"), "values")
        .repartition("key").sortWithinPartitions("size", "kind", "key")
        .write.partitionBy("size", "kind").parquet(path)
    )
    return Models(spark, path, languages, unseen, tables.where(F.col("size") == ORDER).select("gram", "n"))


def _frequent(models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent training n-grams that the bound has room for, and their logarithms by language.

    Whole powers of two of their counts, so that nothing is sorted.
    """
    rows = models.counted.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("level", F.length(F.bin("n")))
    room, least = FREQUENT_CELLS // len(models.languages), None
    for r in sorted(rows.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.uint64), np.empty((0, len(models.languages)), np.float32)
    found = models.probabilities(rows.where(F.col("level") >= least)).toArrow()
    codes = np.frombuffer("".join(found.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    keys = hashed(codes.reshape(-1, ORDER))
    p = found.column("p").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
    order = np.argsort(keys)
    return keys[order], np.log(p[order]).astype(np.float32)


class Scorer:
    """Log sums of words by frequent n-grams, kept as long as there is room; other words have none."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.empty((0, self.logs.shape[1] + 1), np.float64)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows (log sums, length) of the words, and which of them have one."""
        grams, lengths = windows(words)
        different, where = np.unique(hashed(grams), return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, different), max(len(self.keys) - 1, 0))
        known = self.keys[at] == different if len(self.keys) else np.zeros(len(different), bool)
        starts = np.cumsum(lengths) - lengths
        if not len(self.keys):
            return np.zeros((len(words), self.logs.shape[1] + 1)), np.zeros(len(words), bool)
        sums = np.add.reduceat(self.logs[at][where], starts, axis=0, dtype=np.float64)
        return np.column_stack((sums, lengths)), np.logical_and.reduceat(known[where], starts)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.places and len(w) <= KEPT_CHARS]
        if len(self.places) + len(new) > WORDS_KEPT:
            self._clear()
            new = [w for w in words if len(w) <= KEPT_CHARS]
        for k in range(0, len(new), CUT_WORDS):
            part = new[k : k + CUT_WORDS]
            rows, known = self.score(part)
            at = np.where(known, len(self.rows) + np.arange(len(part)), -1)
            self.rows = np.concatenate((self.rows, rows))
            self.places.update(zip(part, at.tolist()))

    def total(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The sum of the words that have a row, and the other words."""
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        known = at >= 0
        return self.rows[at[known]].sum(axis=0), [words[k] for k in np.flatnonzero(~known)]


def entropies(docs: DataFrame, models: Models) -> DataFrame:
    """All columns but ``text``, with the best language, its cross-entropy and its share; nulls without letters.

    ``row`` is an address of its own for each row.  Words of frequent n-grams are added up where the texts are read; the others
    leave as (row, word, count), are scored once each and come back by an equi-join.
    """
    spark = docs.sparkSession
    frequent = _frequent(models)
    shared = spark.sparkContext.broadcast(frequent)
    languages = models.languages
    carried = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            rows, sums, chars = batch.column("row").to_pylist(), [], []
            other: list[tuple[int, str, int]] = []
            texts = [t.lower() if t else "" for t in batch.column("text").to_pylist()]
            short = [WORD.findall(t) if len(t) <= 1 << 20 else None for t in texts]
            scorer.learn({w for words in short if words for w in words})
            for row, text, words in zip(rows, texts, short):
                total = np.zeros(len(languages) + 1)
                rare: Counter = Counter()
                for found in chunked_matches(WORD, text) if words is None else (words,):
                    if words is None:
                        scorer.learn(set(found))
                    part, unknown = scorer.total(found)
                    total += part
                    rare.update(unknown)
                sums.append(total[:-1].tolist())
                chars.append(int(total[-1]))
                other += [(row, word, n) for word, n in rare.items()]
            base = [batch.column(c) for c in carried]
            size = len(rows)
            yield pa.RecordBatch.from_arrays(
                [*base, pa.array(sums, pa.list_(pa.float64())), pa.array(chars, pa.int64()),
                 pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())],
                [*carried, "sums", "chars", "word", "n"],
            )
            for k in range(0, len(other), CUT_WORDS):
                row, word, n = zip(*other[k : k + CUT_WORDS])
                size = len(row)
                base = [pa.array(row, pa.int64()) if c == "row" else pa.nulls(size, batch.column(c).type) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*base, pa.nulls(size, pa.list_(pa.float64())), pa.nulls(size, pa.int64()),
                     pa.array(word, pa.string()), pa.array(n, pa.int64())],
                    [*carried, "sums", "chars", "word", "n"],
                )

    path = fresh_path(spark, "language-scan")
    docs.mapInArrow(scan, f"{fields}, sums array<double>, chars long, word string, n long").write.parquet(path)
    scanned = spark.read.parquet(path)
    rare = scanned.where("word is not null").select("row", "word", "n", _key("word").alias("key"))
    added = [F.sum(F.col("n") * F.col("sums")[k]) for k in range(len(languages))]
    more = (
        rare.select("row", "n", "key").join(models.words(rare), "key").groupBy("row")
        .agg(F.array(*added).alias("more"), F.sum(F.col("n") * F.col("chars")).alias("longer"))
    )
    whole = scanned.where("word is null").drop("word", "n").join(more, "row", "left")
    rated = (
        whole.withColumn("length", F.expr("chars + coalesce(longer, 0L)"))
        .withColumn("all", F.expr("transform(sums, (x, i) -> round(-(x + coalesce(more[i], 0D)) / nullif(length, 0L), 9))"))
        .withColumn("least", F.array_min("all"))
        .withColumn("odds", F.expr(f"aggregate(transform(all, x -> exp(-(x - least) / {TEMPERATURE}D)), 0D, (a, x) -> a + x)"))
    )
    names = F.array(*[F.lit(name) for name in languages])
    best = names[(F.array_position("all", F.col("least")) - 1).cast("int")]
    some = F.col("length") > 0
    result = durable(rated.select(
        *carried, F.when(some, best).alias("lang_pred"), F.when(some, F.col("least")).alias("entropy"),
        F.when(some, 1 / F.col("odds")).alias("share"),
    ))
    discard(spark, path)
    shared.unpersist()
    return result


def identify(
    docs: DataFrame,
    training: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    learn: Column | None = None,
) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for every row of ``docs``.

    Models and bounds are learnt from ``text`` and ``lang`` of all rows of
    ``training``, or of the rows of ``docs`` for which ``learn`` is true; rows
    without a text or a language teach nothing.  The language with the least
    cross-entropy per character wins, ties by name.  ``rejected`` is true if
    that cross-entropy is unusual for training texts of the language; the
    score, between 0 and 1, is the language's share among all, lowered for
    unusual texts.  A null text, or one without letters, is ``und`` with score
    0 and rejected; so is everything if nothing could be learnt.  Repeated
    rows and equal or null doc_ids are each scored; other columns are not
    read; texts are read whole; an empty table gives no rows.  Languages are a
    label's few values: each is one number in every word's score.
    """
    marked = F.lit(False) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"),
        (F.col(f"`{lang}`") if learn is not None else F.lit(None).cast("string")).alias("lang"),
        marked.alias("learn"), F.lit(True).alias("wanted"),
    )
    if training is not None:
        taught = inputs(training, text=text, lang=lang)
        rows = rows.unionByName(taught.select(
            F.lit(None).cast("long").alias("id"), "text", "lang", F.lit(True).alias("learn"), F.lit(False).alias("wanted")
        ))
    rows = rows.withColumn("learn", F.expr("learn and text is not null and lang is not null"))
    prepared(docs.sparkSession)
    models = train(rows.where("learn"))
    if models is None:
        rated = rows.where("wanted").select(
            "id", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("entropy"),
            F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("unusual"),
        )
    else:
        rated = entropies(rows.drop("lang").withColumn("row", F.monotonically_increasing_id()), models)
        taught = rated.where("learn and lang_pred is not null").groupBy(F.col("lang_pred").alias("name")).agg(
            F.avg("entropy").alias("mean"), F.greatest(F.stddev_pop("entropy"), F.lit(LEAST_DEVIATION)).alias("deviation")
        )
        # One row for each language.
        rated = rated.where("wanted").join(F.broadcast(taught), F.col("lang_pred") == F.col("name"), "left").withColumn(
            "unusual",
            F.expr(f"(entropy - coalesce(mean, 0D)) / coalesce(deviation, 1D) - {REJECT_AT}D"),
        )
        models.close()
    sure = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least("unusual", F.lit(40.0))))
    return rated.select(
        F.col("id").alias("doc_id"),
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(F.col("share") * sure, F.lit(0.0)).alias("score"),
        "entropy",
        F.coalesce(F.col("unusual") > 0, F.lit(True)).alias("rejected"),
    )


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn=crc_mod("doc_id", FOLDS) != HELD_OUT)
    return found.select(
        "doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "entropy", "rejected"
    )
