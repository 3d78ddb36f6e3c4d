"""Operator 5, quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: of the target (documents
labelled as good) and of the raw corpus (all documents).  A document's importance
weight is the ratio of its probabilities under the two; its logarithm plus Gumbel
noise is its key, and the documents with the k largest keys are drawn (a sample
without replacement in proportion to the weights).

n-grams are single tokens and pairs of neighbours, hashed into ``BUCKETS`` buckets;
words all in capitals, and n-grams of five tokens seen before in the same document,
are counted as n-grams of their own.

The raw model covers all documents: each task counts its own into a table of fixed
size, the tables are added up by Spark, and the model (one number a bucket) goes back
to the tasks.  The target model and the calibration of k use labelled rows, at most
``most_labelled`` of either label, chosen by a hash of the id.  The k-th key is found
by radix selection over all keys: four counts of 16 bits each, exact at every size.

Defined results: a null or empty text has no n-grams and log weight 0; rows of one id
draw the same noise; rows whose keys tie with the k-th are all kept; without labels
all weights are 0 and every row is kept; an empty table gives an empty result.  All
other columns go through packed, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import drop_table, hash60, map_batches, materialize, score_rows, slices, uniform, unpack

BITS = 14
BUCKETS = 1 << BITS
CAPITALS, AGAIN = BUCKETS, BUCKETS + 1
SEEN_BEFORE = 5
TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of the whole text."""
    import xxhash

    tokens = TOKEN.findall(text)
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n) * _A
    h ^= h >> np.uint64(32)
    shift = np.uint64(64 - BITS)
    pairs = (h[:-1] * _A + h[1:]) * _B
    capitals = sum(map(str.isupper, tokens))
    again = 0
    if n > SEEN_BEFORE:
        runs = np.zeros(n - SEEN_BEFORE + 1, np.uint64)
        for i in range(SEEN_BEFORE):
            runs = runs * _B + h[i:n - SEEN_BEFORE + 1 + i]
        again = len(runs) - len(np.unique(runs))
    return np.concatenate([((h * _B) >> shift).astype(np.int64), (pairs >> shift).astype(np.int64),
                           np.full(capitals, CAPITALS), np.full(again, AGAIN)])


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw for each bucket, and the cut on the log weight that sets k."""

    log_ratio: np.ndarray
    cut: float = 0.0


def labelled_roles(labels: DataFrame, most_labelled: int = 50_000) -> DataFrame:
    """(doc_id, role): 1 target, 2 and 3 good and bad for calibration; at most ``2 * most_labelled`` rows.

    ``labels`` (doc_id, good).  Of several labels of one id the worst counts.
    """
    marked = (labels.filter("doc_id is not null and good is not null")
              .groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good"))
              .withColumn("order", hash60(F.concat_ws("|", F.lit("role"), F.col("doc_id").cast("string")))))
    some = lambda good: marked.filter(F.col("good") == good).orderBy("order", "doc_id").limit(most_labelled)
    return some(1).unionByName(some(0)).select(
        "doc_id", F.when(F.col("good") == 0, 3).when(F.col("order") % 4 == 0, 2).otherwise(1).alias("role"))


def fit(docs: DataFrame, roles: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """Log ratio of each bucket from counts over all documents and over the target's."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    given = given.join(F.broadcast(roles), "doc_id", "left").select("body", (F.col("role") == 1).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS + 2, np.int64), np.zeros(BUCKETS + 2, np.int64)
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            for body, chosen in zip(batch.column("body").to_pylist(), batch.column("target").to_pylist(), strict=True):
                found = np.bincount(buckets(body), minlength=BUCKETS + 2)
                raw += found
                if chosen:
                    target += found
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])],
                                         names=["bucket", "raw", "target"])

    rows = (map_batches(given, count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
    for row in rows:  # one row a bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if target.sum() == 0:
        return np.zeros(BUCKETS + 2)
    p_raw = (raw + 0.5) / (raw + 0.5).sum()
    # The target's counts are smoothed towards the raw model: one pseudo-count a bucket on average.
    p_target = (target + len(raw) * p_raw) / (target.sum() + len(raw))
    return np.log(p_target / p_raw)


def weigh(docs: DataFrame, log_ratio: np.ndarray, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """row, n_grams and log_weight of every document."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def make():
        def score(texts: list[str]) -> tuple[list, list]:
            found = [(len(b), float(ratio.value[b].sum())) for b in map(buckets, texts)]
            return [n for n, _ in found], [w for _, w in found]
        return score

    return score_rows(docs, text, {"n_grams": "long", "log_weight": "double"}, make, columns)


def _cut(sample: list, good_counts: float = 2.0) -> float:
    """The log weight that best parts good from bad; losing good documents counts double."""
    if not sample:
        return -np.inf
    weight = np.array([r["log_weight"] for r in sample])
    good = np.array([r["role"] == 2 for r in sample])
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    caught = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    gain = caught - good_counts * lost
    gain[1:-1][weight[1:] == weight[:-1]] = -np.inf  # no cut between equal weights
    best = int(np.argmax(gain))
    if best == 0:
        return -np.inf
    return float(weight[best] + weight[best - 1]) / 2 if best < len(weight) else np.inf


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs: 16 bits a round, counting all rows that agree so far."""
    if k <= 0:
        return None
    found, left = 0, k
    # As unsigned: the sign bit is turned, so that smaller numbers come first.
    bits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    for shift in (48, 32, 16, 0):
        agree = F.lit(True) if shift == 48 else F.shiftrightunsigned(bits, shift + 16) == found
        part = F.shiftrightunsigned(bits, shift).bitwiseAND(0xFFFF)
        counts = keys.filter(agree).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts, key=lambda r: -r["part"]):  # at most 65,536 rows
            if row["n"] >= left:
                found = found << 16 | row["part"]
                break
            left -= row["n"]
        else:
            return -(1 << 63)  # k is not below the number of rows
    value = found ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def _keyed(docs: DataFrame, ratio: np.ndarray, seed: str, text: str, doc_id: str, columns: list[str] | None) -> DataFrame:
    """``weigh`` with each row's key and its place: keys are below 2^40 in size, at a resolution of 2^-20 they are whole numbers."""
    key = F.col("log_weight") - F.log(-F.log(uniform(seed, F.col("row").getField(doc_id))))
    return weigh(docs, ratio, text, columns).withColumn("key", key).withColumn(
        "place", F.round(F.col("key") * float(1 << 20)).cast("long"))


def _drawn(least: int | None) -> Column:
    return F.lit(False) if least is None else F.col("place") >= least


def _draw(docs: DataFrame, labels: DataFrame, k: int | None, seed: str, most_labelled: int, text: str, doc_id: str,
          columns: list[str] | None) -> tuple[DataFrame, np.ndarray, int | None]:
    """The written scores, the model and the least place that is drawn (None: no row is)."""
    roles = materialize(labelled_roles(labels, most_labelled), "resample-roles")
    ratio = fit(docs, roles, text, doc_id)
    scored = materialize(_keyed(docs, ratio, seed, text, doc_id, columns), "resample-scores")
    if k is None:
        sample = (scored.select(F.col("row").getField(doc_id).alias("doc_id"), "log_weight")
                  .join(F.broadcast(roles.filter("role > 1")), "doc_id")
                  .groupBy("doc_id", "role").agg(F.min("log_weight").alias("log_weight")).collect())  # one row a role
        cut = _cut(sample)
        k = scored.filter(F.col("log_weight") >= F.lit(float(cut))).count()
    least = kth_largest(scored, "place", k)
    drop_table(roles)
    return scored, ratio, least


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: str = "resample",
             most_labelled: int = 50_000, text: str = "text", doc_id: str = "doc_id",
             columns: list[str] | None = None) -> DataFrame:
    """Every row packed as ``row`` (all its columns, or those named) with n_grams, log_weight, key and kept.

    ``labels`` (doc_id, good).  Without ``k``, as many documents are drawn as have a log
    weight over the cut that best parts the labelled good from the labelled bad; of several
    texts of a labelled id the least weight counts for the cut.
    """
    scored, _, least = _draw(docs, labels, k, seed, most_labelled, text, doc_id, columns)
    return scored.withColumn("kept", _drawn(least)).drop("place")


def quality_filter(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: str = "resample",
                   most_labelled: int = 50_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that ``resample`` draws, with the columns of ``docs``.

    Only ids and scores are written to find the k-th key; rows are weighed once more as they are taken, so that no
    second copy of all texts lies on disk.
    """
    scored, ratio, least = _draw(docs, labels, k, seed, most_labelled, text, doc_id, [doc_id])
    drop_table(scored)
    return _keyed(docs, ratio, seed, text, doc_id, None).filter(_drawn(least)).select(unpack(docs.columns))
