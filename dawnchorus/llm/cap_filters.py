"""Operator 9, embedding near-duplicates by spherical-cap filters.

Filters are directions on the sphere; a vector belongs to every filter whose direction
it is close enough to.  Vectors within the wanted angle share a filter almost surely,
others rarely.  The directions form a random product code: after a random structured
rotation (signs and Hadamard transforms) the space is cut in two halves with a random
codebook each, and a direction is a pair of codewords.  So the score of a direction is
the sum of two scores, and all directions over the threshold are listed from two short
tables instead of trying all of them.  Two such codes are used side by side: a vector
that is ill placed in one, with few directions near it, is well placed in the other.

Vectors are joined on shared filters and verified by their cosine in double precision.
A pair is counted only at the smallest filter that both share, so links are added up
without writing pairs out; each bucket also gives, for each member, the smallest id it
is connected with there, from which the components are built.  Equal vectors are merged
before.  A bucket of more than ``BLOCK`` vectors is cut into blocks, and each pair of
blocks is a group of its own: no task holds more than two blocks, however many vectors
a filter has.

The number of filters grows with the number of vectors, so that the vectors met by
chance in a bucket stay few at every size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components are linked with nothing; vectors of different lengths are not compared;
rows of one vec_id count as one vector; a row with a null id has no links and a null
component; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.common import map_batches, materialize
from dawnchorus.llm.components import connected_components

#: Independent product codes, and the filters of each that a vector belongs to on average and at least.
CODES, LISTED, LEAST_LISTED = 2, 20, 10
#: Filters for each vector of the table.
FILTERS_PER_VECTOR = 256
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of each row; the length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


class ProductCode:
    """The filters for vectors of one length: ``size * size`` directions."""

    def __init__(self, length: int, size: int, seed: int = 0):
        self.length, self.size = length, size
        self.width = max(64, 1 << (length - 1).bit_length())
        rng = np.random.default_rng([20240, seed, length, size])
        self.signs = rng.choice([-1.0, 1.0], (2, self.width))
        books = rng.standard_normal((2, size, self.width // 2))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(2)
        self.threshold = self._calibrate(rng)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of unit vectors against both codebooks."""
        wide = np.zeros((len(x), self.width))
        wide[:, :self.length] = x
        for signs in self.signs:
            wide = hadamard(wide * signs)
        half = self.width // 2
        return wide[:, :half] @ self.books[0].T, wide[:, half:] @ self.books[1].T

    def _calibrate(self, rng: np.random.Generator) -> float:
        """The score that random unit vectors exceed for LISTED directions on average."""
        x = rng.standard_normal((200, self.length))
        left, right = self.halves(x / np.linalg.norm(x, axis=1, keepdims=True))
        right = np.sort(right, axis=1)
        low, high = 0.0, 1.0
        for _ in range(30):
            middle = (low + high) / 2
            listed = np.mean([(self.size - np.searchsorted(r, middle - l)).sum() for l, r in zip(left, right, strict=True)])
            low, high = (middle, high) if listed > LISTED else (low, middle)
        return low

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all directions over the threshold, or its best few."""
        out = []
        for start in range(0, len(x), 256):
            for l, r in zip(*self.halves(x[start:start + 256]), strict=True):
                level = self.threshold
                while True:
                    i, j = np.flatnonzero(l >= level - r.max()), np.flatnonzero(r >= level - l.max())
                    sums = l[i][:, None] + r[j][None, :]
                    over = sums >= level
                    if over.sum() >= min(LEAST_LISTED, self.size * self.size):
                        break
                    level -= 0.02
                a, b = np.nonzero(over)
                out.append(np.sort(i[a] * self.size + j[b]))
        return out


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filter_lists(vectors: DataFrame, size: int) -> DataFrame:
    """(id, filter) for each filter of each vector; the number also tells the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vector").to_pylist()
            lengths = np.array([len(r) for r in rows])
            for length in np.unique(lengths):
                if length not in codes:
                    codes[length] = [ProductCode(int(length), size, seed) for seed in range(CODES)]
                at = np.flatnonzero(lengths == length)
                unit = _unit([rows[i] for i in at])
                for seed, code in enumerate(codes[length]):
                    listed = code.decode(unit)
                    filters = np.concatenate(listed) + (int(length) * CODES + seed << 44)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[at], [len(f) for f in listed])), pa.array(filters)], names=["id", "filter"])

    return map_batches(vectors.select("id", "vector"), run, "id long, filter long")


def _smallest_connected(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id that it is connected with."""
    label = ids
    while True:
        spread = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (spread == label).all():
            return label
        label = spread


def _bucket_links(bucket: int, ids: np.ndarray, side: np.ndarray, vectors: np.ndarray, copies: np.ndarray,
                  filters: list, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member that count in this bucket, and the smallest id connected with it here.

    ``side`` tells the block a member belongs to (0 or 1) when two blocks meet; only
    pairs across are looked at then.
    """
    linked = vectors @ vectors.T >= cosine
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return np.zeros(len(ids), np.int64), ids
    lists = [f[:np.searchsorted(f, bucket)] for f in filters]
    lower, place = np.unique(np.concatenate(lists), return_inverse=True)
    counted = linked
    if len(lower):
        member = np.zeros((len(ids), len(lower)), np.float32)
        member[np.repeat(np.arange(len(ids)), [len(x) for x in lists]), place] = 1
        counted = linked & (member @ member.T == 0)
    return counted @ copies, _smallest_connected(linked, ids)


def bucket_links(buckets: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) for each member of each group; rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            key = np.stack([table[c].to_numpy() for c in ("filter", "low", "high")])
            edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
            ids, side, copies = (table[c].to_numpy() for c in ("id", "side", "copies"))
            lists = table["filters"].combine_chunks()
            flat, ends = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()
            vectors = table["vector"].combine_chunks()
            values, lengths = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
            begins = np.concatenate([[0], lengths.cumsum()])
            links, roots = np.zeros(len(ids), np.int64), ids.copy()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                own = _unit(values[begins[a]:begins[b]].reshape(b - a, -1))
                own_lists = np.split(flat[ends[a - 1] if a else 0:ends[b - 1]], ends[a:b - 1] - (ends[a - 1] if a else 0))
                links[a:b], roots[a:b] = _bucket_links(key[0, a], ids[a:b], side[a:b], own, copies[a:b], own_lists, cosine)
            use = (links > 0) | (roots != ids)
            return pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (ids, links, roots)], names=["id", "links", "root"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = [batch.column(c)[len(batch) - 1].as_py() for c in ("filter", "low", "high")]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == k for c, k in zip(("filter", "low", "high"), key, strict=True)])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut or (held and [held[-1].column(c)[0].as_py() for c in ("filter", "low", "high")] != key):
                if held or cut:
                    yield solve([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(held)

    return map_batches(buckets, run, "id long, links long, root long")


def near_duplicates(table: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id",
                    embedding: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id and kept (its component's smallest id)."""
    spark = table.sparkSession
    given = table.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"))
    usable = (F.col("id").isNotNull() & (F.size("vector") > 0)
              & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0))
    single = given.filter(usable).select("id", F.col("vector").cast("array<double>").alias("vector")).distinct()
    classes = materialize(single.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")),
                          "vector-classes")
    members = single.join(classes, "vector").select("id", "rep", "copies")
    vectors = classes.select(F.col("rep").alias("id"), "vector", "copies")
    size = max(64, int(np.ceil(np.sqrt(FILTERS_PER_VECTOR * max(vectors.count(), 1)))))

    listed = filter_lists(vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), size)
    shared = listed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("filter"))).filter("n > 1")
    lists = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("filter", "n"))).alias("shared"))
    entries = materialize(lists.join(vectors, "id"), "filter-lists")  # a vector's list is short: some dozens
    rows = entries.select("id", "vector", "copies", F.transform("shared", lambda s: s["filter"]).alias("filters"),
                          F.explode("shared").alias("own")).select(
        "id", "vector", "copies", "filters", F.col("own.filter").alias("filter"),
        F.ceil(F.col("own.n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "copies", "vector", "filters")
    order = ["filter", "low", "high"]
    dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "id")
    found = materialize(bucket_links(dealt, cosine), "bucket-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    same = members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same))

    counted = (members.join(links.withColumnRenamed("id", "rep"), "rep", "left")
               .select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
               .groupBy("id").agg(F.max("n_links").alias("n_links"))
               .join(component, "id", "left"))
    out = given.select("id").join(counted, "id", "left")
    component_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component_id.alias("component_id"), (F.col("id") == component_id).alias("kept"))
