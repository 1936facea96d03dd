"""Query understanding over a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlex import fixed
from varlex.functions.text import demographic_tags, extract_keywords

ENTITIES = "array<struct<text:string,label:string,meaning:string>>"

# A factory runs once per Python task: texts -> (keywords, entities) per text,
# keywords a list of strings, entities a list of (text, label, meaning).
AnnotatorFactory = Callable[[], Callable[[list[str]], list[tuple[list, list]]]]


def annotate_queries(
    queries: DataFrame,
    annotator: AnnotatorFactory | None = None,
    stop_words: Sequence[str] = fixed.STOP_WORDS,
    text: str = "query",
) -> DataFrame:
    """Original text, keywords, entities and demographic labels per query.

    Without an annotator, keywords are the words that are not stop words and
    the entity list is empty: no language model is available offline.
    """
    parsed = queries.withColumn("original_query", F.col(text))
    if annotator is None:
        parsed = parsed.withColumns(
            {
                "extracted_keywords": extract_keywords(text, stop_words),
                "named_entities": F.array().cast(ENTITIES),
            }
        )
    else:
        kind = pa.struct(
            [
                ("keywords", pa.list_(pa.string())),
                ("entities", pa.list_(pa.struct([(n, pa.string()) for n in ("text", "label", "meaning")]))),
            ]
        )

        def annotate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = annotator()
            for batch in batches:
                yield pa.array(
                    [
                        {
                            "keywords": sorted(set(keywords)),
                            "entities": [dict(zip(("text", "label", "meaning"), e)) for e in entities],
                        }
                        for keywords, entities in model(batch.to_pylist())
                    ],
                    type=kind,
                )

        hook = F.arrow_udf(annotate, f"struct<keywords:array<string>,entities:{ENTITIES}>")
        parsed = (
            parsed.withColumn("_parsed", hook(F.col(text)))
            .withColumns(
                {
                    "extracted_keywords": F.col("_parsed.keywords"),
                    "named_entities": F.col("_parsed.entities"),
                }
            )
            .drop("_parsed")
        )
    return parsed.withColumn("inferred_demographics", demographic_tags(text))
