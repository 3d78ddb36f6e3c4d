"""Operator 13, how quality filters interact, by min-plus removal ranks.

Every document has a mask, the set of filters that it fails.  Under one order of the
filters it is removed at the smallest position that one of its failed filters has:
a matrix of masks (0 where a filter is failed, infinite elsewhere) is combined with the
matrix of positions (the inverse permutations) by addition and minimum.  The resulting
step of every (order, mask) says where the documents of a mask count, so the counts of all
orders are scattered from the few counts of each part's masks; documents are read once,
whatever the number of orders.

Work on Spark: one pass over the texts gives each document's mask and a 128-bit hash of
its text; a grouped minimum by that hash finds repeated texts (partial aggregation, and
the join back to the documents is split by the adaptive skew join when a third of them
hold one text); grouped sums by part and mask leave at most 2^filters rows a part.  The
orders are then worked out part by part in tasks.  Nothing comes to the driver.

Defined results: a null text is an empty one, a null part an empty string; documents
with a null id are never repeated ones and have no labels; rows of one id are judged each by itself, and
are not "smaller" than each other; several labels of one id count as lost if any of
them says so; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import map_batches

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))


def few_words(body: bytes, words: list[bytes]) -> bool:
    return len(words) < LEAST_WORDS


def few_distinct_words(body: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)


def many_capitals(body: bytes, words: list[bytes]) -> bool:
    capitals = len(body) - len(body.translate(None, _CAPITALS))
    return capitals > 0 and 100 * capitals > MOST_CAPITALS_PERCENT * len(body.decode())


def has_symbol(body: bytes, words: list[bytes]) -> bool:
    return len(body.translate(None, SYMBOLS)) < len(body)


#: Filters on one text; each says whether the text fails.  A filter of this value is failed by a repeated text.
REPEATED = None
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool] | None] = {
    "A": few_words, "B": few_distinct_words, "C": many_capitals, "D": has_symbol, "E": REPEATED}


def orders_of(filters: str) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def removal_steps(filters: str, orders: list[str]) -> np.ndarray:
    """(order, mask) -> the step (from 1) at which the order removes a mask's documents; len + 1: never.

    The min-plus product of the masks with the positions of the filters.
    """
    never = len(filters) + 1
    positions = np.array([[order.index(f) + 1 for f in filters] for order in orders])
    failed = np.arange(1 << len(filters))[:, None] >> np.arange(len(filters)) & 1
    masks = np.where(failed == 1, 0, never)
    return np.minimum((positions[:, None, :] + masks[None, :, :]).min(axis=2), never)


def audit_counts(steps: np.ndarray, filters: str, orders: list[str], counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts (order, step) of one part from its counts (mask, [documents, good, toxic])."""
    n, k = len(orders), len(filters)
    place = np.arange(n)[:, None] * (k + 2) + steps  # where each (order, mask) is removed
    lost = [np.bincount(place.ravel(), np.broadcast_to(counts[:, i], steps.shape).ravel(), n * (k + 2))
            .reshape(n, k + 2)[:, 1:].astype(np.int64) for i in range(3)]
    removed = lost[0][:, :k]
    letter = np.array([[filters.index(f) for f in order] for order in orders])
    fails = counts[:, 0] @ (np.arange(1 << k)[:, None] >> np.arange(k) & 1)
    credit = np.zeros(k, np.int64)
    np.add.at(credit, letter.ravel(), removed.ravel())
    return {"kept": counts[:, 0].sum() - removed.cumsum(axis=1), "removed": removed,
            "redundant": fails[letter] - removed, "unique_fails": counts[1 << letter, 0],
            "good_lost": lost[1][:, :k], "toxic_lost": lost[2][:, :k], "shapley": credit[letter]}


def failed_filters(docs: DataFrame, text: str, doc_id: str, part: str,
                   filters: dict[str, Callable[[bytes, list[bytes]], bool] | None]) -> DataFrame:
    """(id, part, mask) of every row: bit i of the mask is set if it fails the i-th filter."""
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"),
                        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                        F.col(f"`{text}`").alias("body"))
    repeated = sum(1 << i for i, f in enumerate(filters.values()) if f is REPEATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tests = [(1 << i, f) for i, f in enumerate(filters.values()) if f is not REPEATED]
        for batch in batches:
            masks, hashes = [], []
            for value in batch.column("body"):
                body = (value.as_py() or "").encode()
                words = body.split()  # of bytes: ASCII white space only
                masks.append(sum(bit for bit, fails in tests if fails(body, words)))
                hashes.append(xxhash.xxh3_128_digest(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), *_halves(hashes)],
                names=["id", "part", "mask", "h1", "h2"])

    rows = map_batches(given, run, "id long, part string, mask int, h1 long, h2 long")
    if not repeated:
        return rows.select("id", "part", "mask")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    return rows.join(first, ["h1", "h2"], "left").select(
        "id", "part", F.when(again, F.col("mask").bitwiseOR(repeated)).otherwise(F.col("mask")).alias("mask"))


def _halves(hashes: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in range(2)]


def audit_filters(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source",
                  filters: dict[str, Callable[[bytes, list[bytes]], bool] | None] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with its counts.

    ``labels`` has the columns doc_id, quality and toxic; ``filters`` maps one letter each to a test of a
    text's bytes and words (true: it fails), or to REPEATED.  The number of orders grows with the factorial
    of the number of filters, so there are at most seven.
    """
    letters = "".join(filters)
    if len(letters) != len(filters) or len(letters) > 7:
        raise ValueError("filters are named by one letter each, and there are seven at most")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed_filters(docs, text, doc_id, part, filters)
    masks = rows.join(marks, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # at most 2^filters entries a part
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = orders_of(letters)
        steps = removal_steps(letters, orders)
        shape = steps.shape[0] * len(letters)
        by_row = [pa.array(np.repeat(orders, len(letters))), pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders)))]
        for batch in batches:
            for name, found in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                counts = np.zeros((1 << len(letters), 3), np.int64)
                for x in found:
                    counts[x["mask"]] = x["n"], x["good"], x["toxic"]
                result = audit_counts(steps, letters, orders, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * shape), *by_row, *[pa.array(np.ascontiguousarray(result[c]).ravel(), pa.int64()) for c in names]],
                    names=["part", "filter_order", "step", *names])

    return map_batches(parts, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))
