"""Text expressions: cleaning, templates, labels, keywords, routing."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from varlex import fixed


def to_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(f"`{value}`")


def strip_whitespace(value: Column | str) -> Column:
    """Remove every kind of leading and trailing white space, not only blanks."""
    return F.regexp_replace(to_column(value), r"^\s+|\s+$", "")


def clean_text(value: Column | str) -> Column:
    """Drop special characters, lower, trim blanks."""
    return F.trim(F.lower(F.regexp_replace(to_column(value), fixed.CLEAN_PATTERN, "")))


def clean_name(value: Column | str) -> Column:
    return F.trim(F.lower(to_column(value)))


def composite_text(
    source: Column | str = "source_dataset",
    name: Column | str = "variable_name",
    description: Column | str = "description",
) -> Column:
    """Source, cleaned name and cleaned description; nulls are skipped."""
    return F.concat_ws(
        fixed.TEXT_SEPARATOR, to_column(source), clean_name(name), clean_text(description)
    )


def prefix_concat(prefix: str, value: Column | str) -> Column:
    """``prefix_value``; a null value leaves the bare prefix."""
    return F.concat_ws("_", F.lit(prefix), to_column(value))


def text_or_none(value: Column | str) -> Column:
    """A value as text, with a null spelled ``None`` as in printed templates."""
    return F.coalesce(to_column(value).cast("string"), F.lit("None"))


def first_truthy(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else the last value."""
    columns = [to_column(v).cast("string") for v in values]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


_SLICE = re.compile(r"^(?P<name>.+)\[:(?P<stop>\d+)\]$")


def field_expr(expression: str) -> Column:
    """A template field: ``name``, ``a or b or c`` or ``name[:100]``."""
    cut = _SLICE.match(expression)
    if cut:
        return F.substring(to_column(cut["name"]), 1, int(cut["stop"]))
    return first_truthy(*[part.strip() for part in expression.split(" or ")])


def truncate(value: Column | str, chars: int = fixed.SHORT_NAME_CHARS) -> Column:
    return F.substring(to_column(value), 1, chars)


def render(template: str) -> Column:
    """A text template with ``{field}`` placeholders as one concat expression."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(text_or_none(field_expr(field)))
    return F.concat(*parts)


def template_fields(template: str) -> set[str]:
    """Column names a template or field expression reads."""
    fields = [f for _, f, _, _ in Formatter().parse(template) if f is not None]
    names: set[str] = set()
    for field in fields or ([] if "{" in template else [template]):
        cut = _SLICE.match(field)
        names.update([cut["name"]] if cut else [p.strip() for p in field.split(" or ")])
    return names


def contains_any(value: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(n) for n in needles])


def demographic_tags(query: Column | str) -> Column:
    """Ordered demographic labels found by substring; empty array if none."""

    def labels(lowered: Column) -> Column:
        hits = [F.when(contains_any(lowered, w), F.lit(label)) for label, w in fixed.DEMOGRAPHICS]
        return F.array_compact(F.array(*hits))

    # The lambda binds the lowered text once for all substring tests.
    return F.transform(F.array(F.lower(to_column(query))), labels)[0]


def words(value: Column | str) -> Column:
    """Distinct lower-case words of a text."""
    parts = F.split(F.lower(to_column(value)), fixed.WORD_BREAK)
    return F.array_distinct(F.array_remove(parts, ""))


def extract_keywords(
    query: Column | str, stop_words: Sequence[str] = fixed.STOP_WORDS
) -> Column:
    """Sorted distinct words without stop words.

    No part-of-speech model is available offline, so every word that is not a
    stop word counts as a content word; pass a tagger to ``annotate_queries``
    to replace this.
    """
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.sort_array(F.array_except(words(query), stops))


def pair_text(
    source: Column | str = "source_dataset",
    name: Column | str = "variable_name",
    description: Column | str = "description",
) -> Column:
    """The candidate side of a rerank pair."""
    return F.concat_ws(
        fixed.TEXT_SEPARATOR,
        to_column(source),
        to_column(name),
        F.coalesce(to_column(description), F.lit("")),
    )


def word_overlap(query: Column | str, candidate: Column | str) -> Column:
    """Share of distinct query words that occur in the candidate text."""
    wanted = words(query)
    found = F.size(F.array_intersect(wanted, words(candidate)))
    share = found.cast("double") / F.size(wanted)
    return F.round(F.when(F.size(wanted) > 0, share).otherwise(F.lit(0.0)), 6)


def resolve_keys(metadata: Column | str, keys: Sequence[str], default: str) -> Column:
    """First key present in the map; an empty value counts as present."""
    mapping = to_column(metadata)
    return F.coalesce(*[F.try_element_at(mapping, F.lit(k)) for k in keys], F.lit(default))


def route_source(source: Column | str) -> Column:
    """Observation family of a source name; null where no rule matches."""
    text = strip_whitespace(F.lower(to_column(source)))
    routed: Column | None = None
    for family, needles in fixed.ROUTES:
        hit = contains_any(text, needles)
        routed = F.when(hit, family) if routed is None else routed.when(hit, family)
    assert routed is not None
    return routed


def route_table(table: Column | str) -> Column:
    """Upper-cased wide table id, or the default where none is given."""
    value = to_column(table)
    given = (value != "") & (value != fixed.NOT_AVAILABLE)
    return F.when(given, F.upper(value)).otherwise(F.lit(fixed.DEFAULT_WIDE_TABLE))
