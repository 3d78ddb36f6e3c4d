"""Operator 4, toxicity by cumulative-link ordinal regression.

The severity grade y (0 clean ... G-1 worst) of a document follows
``P(y <= j) = sigmoid(cut_j - x.w)``: one weight vector shared by all ordered cuts.
The features x are sparse: the words of the text in lower case and their first 3 to 7
letters (so that inflected forms share a weight), as the logarithm of their rate per
100 words.  The output is the expected severity, the sum of P(y > j).

The features are the ``most_features`` words and word beginnings whose presence
differs most between labelled toxic and clean documents, counted by Spark over the
training rows.  The model is fitted by gradient descent on at most ``most_labelled``
labelled rows of either kind, chosen by a hash of the id; scoring covers every row
and whole texts.  A row is toxic when P(y > 0) reaches the level that best parts the
training rows, falsely flagged ones counting double.

Defined results: a null or empty text has no features and scores as such; rows of one
id with different texts are scored apart; without toxic labels nothing is flagged; an
empty table gives an empty result.  All other columns go through packed, whatever
their names.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import drop_table, hash60, map_batches, materialize, score_rows, slices, unpack

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(3, 8)


def term_counts(text: str) -> tuple[Counter, int]:
    """How often each word and word beginning occurs (a beginning ends in ``-``), and the number of words."""
    words = Counter(WORD.findall(text.lower()))
    terms = Counter(words)
    for word, n in words.items():
        for size in BEGINNINGS:
            if size < len(word):
                terms[word[:size] + "-"] += n
    return terms, sum(words.values())


def known_counts(text: str, known: dict[str, int]) -> tuple[dict[int, int], int]:
    """``term_counts`` of the known terms alone, by their numbers."""
    words = Counter(WORD.findall(text.lower()))
    found: dict[int, int] = {}
    for word, n in words.items():
        if word in known:
            found[known[word]] = found.get(known[word], 0) + n
        for size in BEGINNINGS:
            if size >= len(word):
                break
            if (term := known.get(word[:size] + "-")) is not None:
                found[term] = found.get(term, 0) + n
    return found, sum(words.values())


def values(counts: dict[int, int], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter(counts, np.int64, len(counts))
    rate = np.fromiter(counts.values(), np.float64, len(counts)) * 100 / max(n_words, 1)
    return at, np.log1p(rate)


@dataclass(frozen=True)
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one fewer than grades
    level: float  # P(y > 0) from which a row counts as toxic

    def above(self, text: str) -> np.ndarray:
        """P(y > j) for each cut."""
        at, x = values(*known_counts(text, self.terms))
        return 1 / (1 + np.exp(self.cuts - float(self.weights[at] @ x)))


def training_rows(docs: DataFrame, grades: DataFrame, most_labelled: int, text: str, doc_id: str) -> DataFrame:
    """(body, grade) of at most ``most_labelled`` clean and as many toxic documents."""
    marked = (grades.filter("doc_id is not null and grade is not null").groupBy("doc_id")
              .agg(F.max(F.col("grade").cast("int")).alias("grade"))
              .withColumn("order", hash60(F.concat_ws("|", F.lit("grade"), F.col("doc_id").cast("string")))))
    some = lambda rows: rows.orderBy("order", "doc_id").limit(most_labelled)
    chosen = some(marked.filter("grade = 0")).unionByName(some(marked.filter("grade > 0"))).select("doc_id", "grade")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return materialize(given.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
                       .select("doc_id", "body", "grade"), "grade-rows")


def choose_terms(rows: DataFrame, most_features: int, least_documents: int = 3, least_errors: float = 3.0) -> dict[str, int]:
    """Terms whose share of toxic documents differs most from that of clean ones.

    Only differences of ``least_errors`` standard errors and more: with many thousand
    terms some differ by chance, and in small samples they would carry the fit.
    """

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            tables = [list(term_counts(t)[0]) for t in batch.column("body").to_pylist()]
            toxic = np.repeat(np.array([g > 0 for g in batch.column("grade").to_pylist()], bool), [len(t) for t in tables])
            yield pa.RecordBatch.from_arrays([pa.array([x for t in tables for x in t], pa.string()), pa.array(toxic)],
                                             names=["term", "toxic"])

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("k")).first()
    n_toxic, n_clean = size["k"] or 0, size["n"] - (size["k"] or 0)
    if not n_toxic or not n_clean:
        return {}
    counts = (map_batches(rows.select("body", "grade"), present, "term string, toxic boolean")
              .groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= least_documents))
    p = F.col("t") / n_toxic - (F.col("n") - F.col("t")) / n_clean
    share = (F.col("n") + 1) / (n_toxic + n_clean + 2)
    score = F.abs(p) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    top = counts.select("term", score.alias("score")).filter(F.col("score") >= least_errors).orderBy(F.desc("score"), "term").limit(most_features).collect()
    return {r["term"]: i for i, r in enumerate(top)}


def fit_ordinal(x: np.ndarray, at: np.ndarray, row: np.ndarray, y: np.ndarray, n_features: int,
                rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts by Adam on the mean log likelihood; x holds the values at (row, at)."""
    grades = int(y.max()) + 1
    share = np.array([(y <= j).mean() for j in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # Unconstrained: the first cut, then logarithms of the steps between cuts.
    theta = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, rounds + 1):
        w, steps = theta[:n_features], np.exp(theta[n_features + 1:])
        cuts = theta[n_features] + np.concatenate([[0], np.cumsum(steps)])
        score = np.bincount(row, x * w[at], len(y))
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(bounds[y + 1] - score), sigmoid(bounds[y] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p / len(y), low * (1 - low) / p / len(y)
        g_w = np.bincount(at, x * (d_high - d_low)[row], n_features) + ridge * w
        g_cut = np.array([d_low[y == j + 1].sum() - d_high[y == j].sum() for j in range(grades - 1)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        gradient = np.concatenate([g_w, tail[:1], tail[1:] * steps])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    steps = np.exp(theta[n_features + 1:])
    return theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(steps)])


def _level(p: np.ndarray, toxic: np.ndarray, false_counts: float = 2.0) -> float:
    order = np.argsort(-p, kind="stable")
    p, toxic = p[order], toxic[order]
    gain = np.cumsum(toxic) / toxic.sum() - false_counts * np.cumsum(~toxic) / max((~toxic).sum(), 1)
    best = int(np.argmax(gain))
    return float(p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2


def fit(docs: DataFrame, grades: DataFrame, most_labelled: int = 15_000, most_features: int = 3000,
        text: str = "text", doc_id: str = "doc_id") -> Model | None:
    """``grades`` (doc_id, grade: 0 clean, higher worse).  None when one kind is missing.

    Of the training rows only their known terms come to the driver: at most
    ``2 * most_labelled`` rows of at most ``most_features`` numbers.
    """
    rows = training_rows(docs, grades, most_labelled, text, doc_id)
    terms = choose_terms(rows, most_features)
    if not terms:
        drop_table(rows)
        return None
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            found = [values(*known_counts(t, known.value)) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "grade", "at", "x"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, grade int, at array<int>, x array<float>"
    sample = map_batches(rows, features, schema).toArrow().sort_by("doc_id")
    drop_table(rows)
    sizes = np.array([len(a) for a in sample["at"].to_pylist()], np.int64)
    at = sample["at"].combine_chunks().flatten().to_numpy().astype(np.int64)
    x = sample["x"].combine_chunks().flatten().to_numpy().astype(np.float64)
    y = sample["grade"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), sizes)
    weights, cuts = fit_ordinal(x, at, row, y, len(terms))
    p = 1 / (1 + np.exp(cuts[0] - np.bincount(row, x * weights[at], len(y))))
    return Model(terms, weights, cuts, _level(p, y > 0))


def grade_by_terms(docs: DataFrame, labels: DataFrame, most_labelled: int = 15_000, grades: int = 3,
                   text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Ordered grades from labels that only say toxic or not.

    A two-grade model is fitted first; the documents labelled as toxic are then cut
    into ``grades - 1`` equal parts by its score.  (doc_id, grade)
    """
    simple = labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))
    model = fit(docs, simple, most_labelled, text=text, doc_id=doc_id)
    if model is None:
        return simple
    chosen = training_rows(docs, simple, most_labelled, text, doc_id)
    scored = materialize(score_severity(chosen.select("doc_id", "body", "grade"), model, "body")
                         .select("row.doc_id", "row.grade", "severity"), "grades")
    drop_table(chosen)
    bounds = scored.filter("grade > 0").approxQuantile("severity", [i / (grades - 1) for i in range(1, grades - 1)], 0.001)
    level = F.lit(1)
    for bound in bounds:
        level = level + (F.col("severity") > bound).cast("int")
    return scored.select("doc_id", F.when(F.col("grade") == 0, 0).otherwise(level).alias("grade"))


def score_severity(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row packed as ``row`` (all its columns, or those named) with severity (expected grade) and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def score(texts: list[str]) -> tuple[list, list]:
            above = [shared.value.above(t) for t in texts]
            return [float(a.sum()) for a in above], [bool(a[0] >= shared.value.level) for a in above]
        return score

    return score_rows(docs, text, {"severity": "double", "toxic": "boolean"}, make, columns)


def judge_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = 15_000, text: str = "text",
                   doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``labels`` (doc_id, toxic 0/1) -> every row packed as ``row`` with severity and toxic."""
    grades = grade_by_terms(docs, labels, most_labelled, text=text, doc_id=doc_id)
    model = fit(docs, grades, most_labelled, text=text, doc_id=doc_id)
    return score_severity(docs, model or Model({}, np.zeros(0), np.array([0.0]), 2.0), text, columns)


def toxicity_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are not toxic, with the columns of ``docs``."""
    return judge_toxicity(docs, labels, **options).filter("not toxic").select(unpack(docs.columns))
