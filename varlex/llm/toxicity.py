"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlex.llm.common import BoundedCache, crc_mod, documents, durable, inputs

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
# The model is fitted on labelled documents with different texts of up to so many characters: at most so many of each class.
SAMPLE_PER_CLASS = 3_000
SAMPLE_CHARS = 30_000
# Features enter the model if toxic documents have them more often, by so many standard errors.
SELECT_AT = 5.0
MAX_FEATURES = 4_000
STEPS = 300
RATE = 0.2
DECAY = 1e-6
SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
GRAMS = (4, 5)


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and different lower-case words of each sentence that has one."""
    start = 0
    for end in chain((m.start() for m in SENTENCE_END.finditer(text)), (len(text),)):
        if end > start:
            words = set(WORD.findall(text[start:end].lower()))
            if words:
                yield start, end, words
        start = end + 1


def parts(word: str) -> Iterator[str]:
    """A whole word and the character n-grams it has, its start marked, with repeats: one at a time, as a run of letters may be long."""
    marked = "^" + word
    yield marked + "$"
    for n in GRAMS:
        for k in range(len(marked) - n + 1):
            yield marked[k : k + n]


@dataclass(frozen=True)
class Model:
    """A document is clean if no sentence is toxic and no leak makes it toxic.

    P(toxic) = 1 - (1 - leak) * product over sentences of (1 - sigmoid(bias + weights of its words)).
    The leak takes what no sentence explains, so that a long text isn't toxic
    for its length.
    """

    weights: dict[str, float]
    bias: float
    leak: float


class Scorer:
    """A model with the weights of the words met so far."""

    def __init__(self, model: Model):
        self.model, self.known = model, BoundedCache()

    def logits(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence that has a word."""
        found = list(sentences(text))
        known, weights, bias = self.known, self.model.weights, self.model.bias
        for word in known.missing(chain.from_iterable(words for _, _, words in found)):
            known[word] = sum(weights[f] for f in {f for f in parts(word) if f in weights})
        return [(start, end, bias + sum(map(known.__getitem__, words))) for start, end, words in found]

    def score(self, text: str | None, threshold: float = THRESHOLD) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability that a whole text is toxic, and the sentences that are toxic on their own.

        Without words the probability is the leak; sentences come as start,
        end and probability.
        """
        rated = self.logits(text or "")
        z = np.array([z for _, _, z in rated], np.float64)
        whole = float(-np.expm1(np.log1p(-self.model.leak) - np.logaddexp(0.0, z).sum()))
        p = _sigmoid(z)
        return min(1.0, max(0.0, whole)), [(*rated[k][:2], float(p[k])) for k in np.flatnonzero(p >= threshold)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def select(texts: list[str], labels: np.ndarray) -> list[str]:
    """Features that toxic documents have significantly more often than the others."""
    toxic, clean = Counter(), Counter()
    # Toxic documents first: of the others only what those have is counted.
    for text, label in sorted(zip(texts, labels), key=lambda pair: not pair[1]):
        words = set().union(*(words for _, _, words in sentences(text)))
        if label:
            toxic.update({f for word in words for f in parts(word)})
        else:
            clean.update({f for word in words for f in parts(word) if f in toxic})
    n1, n0 = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    rated = []
    for feature, a in toxic.items():
        b = clean.get(feature, 0)
        share = (a + b) / (n1 + n0)
        error = np.sqrt(max(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        z = (a / n1 - b / n0) / error
        if z >= SELECT_AT:
            rated.append((-z, feature))
    return [feature for _, feature in sorted(rated)[:MAX_FEATURES]]


def fit(texts: list[str], labels: list[int], importance: list[float]) -> Model:
    """Gradient steps (Adam) on the documents' log-likelihood under the noisy-or.

    Labels of one class alone, or none, give a model that scores 1 or 0.
    """
    y, share = np.array(labels, np.float64), np.array(importance, np.float64)
    if not 0 < y.sum() < len(y):  # with one class alone there is nothing to tell apart
        return Model({}, -40.0, 1 - 1e-9 if len(y) and y.all() else 0.0)
    share = share / max(share.sum(), 1e-9)
    chosen = {feature: k for k, feature in enumerate(select(texts, y))}
    row, column, document = [], [], []
    for k, text in enumerate(texts):
        for _, _, words in sentences(text):
            for word in words:
                for feature in {f for f in parts(word) if f in chosen}:
                    row.append(len(document))
                    column.append(chosen[feature])
            document.append(k)
    row, column, document = (np.array(x, np.int64) for x in (row, column, document))
    weights = np.zeros(len(chosen))
    # Bias of a sentence and log-odds of the leak are learnt like weights.
    extra = np.array([-5.0, -3.5])
    moments = [np.zeros(len(chosen)), np.zeros(len(chosen)), np.zeros(2), np.zeros(2)]
    for step in range(1, STEPS + 1):
        p = _sigmoid(extra[0] + np.bincount(row, weights[column], len(document)))
        leak = _sigmoid(extra[1:])[0]
        clean = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + np.log1p(-leak)
        toxic = -np.expm1(clean)
        # Slope of the log-likelihood along log P(clean).
        slope = share * np.where(y > 0, -np.exp(clean) / np.maximum(toxic, 1e-9), 1.0)
        at_z = -slope[document] * p
        ups = (np.bincount(column, at_z[row], len(chosen)) - DECAY * weights,
               np.array([at_z.sum(), -(slope * leak).sum()]))
        for value, up, m, v in zip((weights, extra), ups, moments[::2], moments[1::2]):
            m += 0.1 * (up - m)
            v += 0.01 * (up * up - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
    return Model(dict(zip(chosen, weights.tolist())), float(extra[0]), float(_sigmoid(extra[1:])[0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """A model from the labels of documents outside the held-out fold.

    Fitted on a bounded sample: of each class the ``per_class`` different
    texts (of at most ``SAMPLE_CHARS`` characters) with the smallest hashes,
    weighted so that the classes count as in all labelled documents.  Labels
    other than 0 and 1 and null ids and texts are left out.  The fit runs in
    one task, as large as the bound; the driver gets the weights.
    """
    fold = crc_mod("id", FOLDS)
    marks = inputs(labels, id=label_id, label=label).where(F.col("label").isin(0, 1) & (fold != HELD_OUT))
    rows = inputs(docs, id=doc_id, text=text).where("text is not null").where(F.length("text") <= SAMPLE_CHARS)
    # Hashes stand for the texts in the join with the labels; equal texts count once.
    hashes = rows.select("id", F.xxhash64("text").alias("h")).join(marks, "id")
    once = durable(hashes.groupBy("h").agg(F.max("label").alias("class")))
    known = {r["class"]: r["n"] for r in once.groupBy("class").agg(F.count("*").alias("n")).collect()}
    chosen = [once.where(F.col("class") == c).orderBy("h").limit(per_class) for c in (0, 1)]
    # At most two times per_class hashes.
    wanted = F.broadcast(durable(chosen[0].unionByName(chosen[1])))
    picked = rows.select(F.xxhash64("text").alias("h"), "text").join(wanted, "h")
    sample = durable(picked.groupBy("h").agg(F.min("text").alias("text"), F.max("class").alias("label")))
    taken = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {c: known.get(c, 0) / max(1, taken.get(c, 0)) for c in (0, 1)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, found = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            found += batch.column("label").to_pylist()
        model = fit(texts, found, [share[c] for c in found])
        names, values = list(model.weights), list(model.weights.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["bias", "leak", *names]), pa.array([model.bias, model.leak, *values])], ["feature", "weight"]
        )

    weights = sample.select("text", "label").repartition(1).mapInArrow(run, "feature string, weight double").collect()
    found = {r["feature"]: r["weight"] for r in weights}
    bias, leak = found.pop("bias", -40.0), found.pop("leak", 0.0)
    return Model(found, bias, leak)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, sentences) of every row's whole text.

    ``sentences`` holds (start, end, probability) of the sentences that are
    toxic on their own.  Null and empty texts and texts without words score
    the model's leak.  Repeated rows and equal or null doc_ids are scored
    each; other columns are not read; an empty table gives no rows.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            found = [scorer.score(t) for t in batch.column("text").to_pylist()]
            places = [[{"start": s, "end": e, "probability": p} for s, e, p in places] for _, places in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.float64()), pa.array(places, kind)],
                ["doc_id", "score", "sentences"],
            )

    rows = inputs(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, score double, sentences array<struct<start:long,end:long,probability:double>>"
    return rows.mapInArrow(scan, schema)


def op1_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "sentences",
    )
