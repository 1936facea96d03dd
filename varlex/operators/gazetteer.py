"""Entities of a text by stored names: the longest names that its words spell.

Texts are cut into the word sequences that can be a name: bitmaps of the names'
first words with their lengths, and of all their words, are broadcast and let
hardly any other sequence through.  Those that are left are found by one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions.text import to_column
from varlex.operators.annotate import ENTITIES, annotate_queries
from varlex.operators.skew import maybe_wanted


def word_sequence(value: Column | str) -> Column:
    """Lower-case words of a text in order, repeats included."""
    return F.filter(F.split(F.lower(to_column(value)), fixed.WORD_BREAK), lambda w: w != "")


def names_by_words(names: DataFrame, name: str = "name", label: str = "label", meaning: str = "meaning") -> DataFrame:
    """(spelled, first, n_words, label, meaning): one row for each different sequence of words.

    Of names that are spelled alike the smallest label, then meaning, stays
    (null first); names without a word are left out.
    """
    split = names.select(word_sequence(name).alias("_words"), F.col(label).alias("label"), F.col(meaning).alias("meaning"))
    spelled = split.where(F.size("_words") > 0).select(
        F.array_join("_words", " ").alias("spelled"), F.col("_words")[0].alias("first"), F.size("_words").alias("n_words"), "label", "meaning"
    )
    return spelled.groupBy("spelled", "first", "n_words").agg(F.min(F.struct("label", "meaning")).alias("entry")).select(
        "spelled", "first", "n_words", "entry.label", "entry.meaning"
    )


def matches(texts: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, n_words, spelled, label, meaning): at each place of a text the names that start there."""
    # No more numbers than names have different lengths.
    lengths = sorted(r[0] for r in gazetteer.select("n_words").distinct().collect()) or [1]
    words = texts.select(key, word_sequence(text).alias("_words")).where(F.size("_words") > 0)
    # A place carries no more words than the longest name has.
    windows = F.transform(F.sequence(F.lit(1), F.size("_words")), lambda i: F.slice("_words", i, lengths[-1]))
    places = words.select(key, F.posexplode(windows).alias("at", "window"))
    starts = places.select(
        key, "at", "window", F.col("window")[0].alias("first"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n_words")
    ).where(F.col("n_words") <= F.size("window"))
    tried = maybe_wanted(starts, gazetteer, ["first", "n_words"]).select(
        key, "at", F.array_join(F.slice("window", F.lit(1), F.col("n_words")), " ").alias("spelled")
    )
    return maybe_wanted(tried, gazetteer, ["spelled"]).join(gazetteer.drop("first"), "spelled").select(
        key, "at", "n_words", "spelled", "label", "meaning"
    )


def from_the_left(matches: DataFrame, key: str) -> DataFrame:
    """(key, named_entities): matches in order, without those that start inside the one before that stayed.

    Of those at one place the longest comes first, so the others start inside it.
    """
    listed = matches.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("at", (-F.col("n_words")).alias("shorter"), "n_words", F.col("spelled").alias("text"), "label", "meaning")
    )).alias("_all"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(ENTITIES).alias("kept"))

    def step(state: Column, match: Column) -> Column:
        taken = F.struct(
            (match["at"] + match["n_words"]).alias("end"),
            F.concat(state["kept"], F.array(F.struct(match["text"], match["label"], match["meaning"]))).cast(ENTITIES).alias("kept"),
        )
        return F.when(match["at"] >= state["end"], taken).otherwise(state)

    return listed.select(key, F.aggregate("_all", empty, step, lambda state: state["kept"]).alias("named_entities"))


def link_entities(texts: DataFrame, names: DataFrame, text: str = "query", **columns: str) -> DataFrame:
    """``texts`` with ``named_entities``: the names in each text, longest first from the left.

    Words are runs of letters and digits, compared in lower case.  At each
    place the longest name counts; a name that starts inside one already
    taken doesn't.  ``names`` has name, label and meaning (or the given
    columns).  Entities follow from the text alone, so equal texts are
    linked once; null and empty texts, and those without a name, have none.
    """
    gazetteer = names_by_words(names, **columns)
    key = F.unhex(F.sha2(to_column(text), 256))
    different = texts.where(F.col(text).isNotNull()).select(key.alias("_text_key"), F.col(text).alias("_text")).dropDuplicates(["_text_key"])
    found = from_the_left(matches(different, gazetteer, "_text_key", "_text"), "_text_key")
    kept = [c for c in texts.columns if c != "named_entities"]
    return texts.select(*kept).withColumn("_text_key", key).join(found, "_text_key", "left").select(
        *kept, F.coalesce("named_entities", F.array().cast(ENTITIES)).alias("named_entities")
    )


def annotate_with_names(queries: DataFrame, names: DataFrame, text: str = "query", **options) -> DataFrame:
    """``annotate_queries`` with the entities of a gazetteer."""
    parsed = annotate_queries(queries, text=text, **options)
    linked = link_entities(parsed, names, text)
    return linked.select(*parsed.columns)
