"""Operator 8, n-gram Jaccard join by partitioning the universe of shingles.

Two sets of sizes r <= s with a Jaccard similarity of at least 0.8 differ in at most
(r + s) / 9 elements.  The universe of shingles is cut by hash into segments, more of
them than a pair may differ in elements; so the sets of a pair agree entirely on some
segments (pigeonhole).  Documents are joined on the hashes of their segments:

* *Size bands.*  Sets of a band (sizes within a factor of 1.35) share one number of
  segments; a set small enough for a partner in the band below also enters there.
* *Open documents.*  There are a third more segments than needed, so the sets of a pair
  agree on more of them than the ``spare`` ones.  A set that shares no more than that with
  any others has no partner and is done with; this is counted by document, with no pair written out.
* *Stars.*  Each open document is compared with the one representative, a bucket's first member, that it
  shares most segments with.  What is linked takes one label, and buckets of one label count no more.
* *The finest partition.*  For what is still open every shingle is a segment of its own: only documents
  stay open that share enough of their shingles with others of a size that they may be similar to.
* *Allocation by cost.*  Each of them passes over its costliest shingles, as many as are to spare, and meets
  the others in the remaining buckets.  All order shingles alike, so the cheapest one that a pair has in common
  remains for both, and nothing else in common comes after it.  As long as there would be many meetings and stars at the
  shingles' hubs find links, those go first: n near copies cost about n comparisons.
* *One-deletion neighbourhoods.*  What would still meet others enters each segment with each one element
  left out as well, which finds partners that differ there in one element.  Such an agreement weighs one and a
  whole one two, and again only documents that share more weight than may be missing stay open.
* *Parities.*  A pair that meets differs in at least as many elements as there are segments, of a partition into
  1024, in which one set has an odd and the other an even number; if these are too many it is no candidate.
* *Exact verification.*  Every candidate pair is compared by its actual shingles.

A bucket's members within one batch of rows are reduced to the first of them before the
shuffle, so a bucket that a third of all documents share has a row a batch there, not a row a document.
Copies of a text are merged before.  No bucket's pairs are written out while its documents can be closed otherwise.

Defined results: a null, empty or blank text has no shingles, and is linked with
nothing; a text of fewer than five words has one shingle, all its words; rows with a
null id take no part (component null); rows of one id with different texts are judged each by
its own text, and repeated rows alike; an empty table gives an empty result.  Other columns of the input
are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.common import drop_table, map_batches, materialize
from dawnchorus.llm.components import connected_components

WORDS = 5
BAND_RATIO = 1.35
#: Ids of documents to compare that are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Shingle rows for one meeting in a bucket, below which stars are tried first.
ROWS_A_MEETING = 1
#: Words of 64 segments whose parities are compared.
PARITIES = 16
#: Bucket rows of a batch in which members of one bucket are reduced to the first.
BLOCK_ROWS = 2_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                         0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mix((hashes * _MULTIPLIERS[:len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += hashes[i:i + n] * _MULTIPLIERS[i]
    return np.unique(mix(total))


def shingles(text: str | None) -> set[bytes]:
    """The shingles themselves."""
    words = (text or "").encode().lower().split()
    if 0 < len(words) < WORDS:
        return {b" ".join(words)}
    return {b" ".join(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)}


def similar(a: set, b: set, percent: int = 80) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both) > 0


@dataclass(frozen=True)
class Band:
    """Sizes up to ``most``; the sets of a similar pair agree on more than ``spare`` segments.

    With one-deletion neighbourhoods whole agreement weighs 2 and a difference of one element 1; the
    pair's agreements then weigh more than ``spare_weight``.
    """

    number: int
    most: int

    @property
    def reach(self) -> int:
        """The largest set that probes here."""
        return self.most * 5 // 4

    @property
    def differ(self) -> int:
        return (self.most + self.reach) // 9

    @property
    def segments(self) -> int:
        need = self.differ + 1
        return need + -(-need // 3) if self.differ else 1

    @property
    def spare(self) -> int:
        return self.segments - self.differ - 1

    @property
    def spare_weight(self) -> int:
        return 2 * self.segments - self.differ - 1


def band_tops(most: int) -> list[int]:
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, int(tops[-1] * BAND_RATIO)))
    return tops


def bands_of(size: int) -> list[Band]:
    """The set's own band, and the one below when it can have a partner there."""
    tops = band_tops(size)
    own = Band(len(tops) - 1, tops[-1])
    below = Band(len(tops) - 2, tops[-2]) if len(tops) > 1 else None
    return [own, below] if below and below.reach >= size else [own]


#: How a row's tag packs its facts: ((segment << 24 | spare) << 1 | below) << 1 | part of the segment only.
_SPARE_BITS = 24
_SEGMENT = f"shiftright(tag, {_SPARE_BITS + 2})"
_SPARE = f"shiftright(tag, 2) & {(1 << _SPARE_BITS) - 1}"
_BELOW = "(tag & 2) = 2"
_WEIGHT = "if((tag & 1) = 1, 1, 2)"


def signatures(hashes: np.ndarray, band: Band, below: bool, deletions: bool) -> tuple[np.ndarray, np.ndarray]:
    """The set's bucket keys in a band and the tag of each."""
    m = band.segments
    place = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # grows with the hash, so it is sorted
    edges = np.searchsorted(place, np.arange(m + 1, dtype=np.uint64))
    mixed = mix(hashes + np.uint64(0x632BE59BD9B4E019))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    keys = sums[edges[1:]] - sums[edges[:-1]]
    at = np.arange(m, dtype=np.uint64)
    if deletions:
        keys, at = np.concatenate([keys, keys[place] - mixed]), np.concatenate([at, place])
    salt = np.uint64((band.number + 1) * 0x9FB21C651E98DF25 % (1 << 64))
    keys = mix(keys + mix(at * np.uint64(0xD1B54A32D192ED03) + salt))
    spare = min(band.spare_weight if deletions else band.spare, (1 << _SPARE_BITS) - 1)
    tags = ((at.astype(np.int64) << _SPARE_BITS | spare) << 1 | int(below)) << 1
    tags[m:] |= 1
    return keys.view(np.int64), tags


def signature_rows(docs: DataFrame, deletions: bool = False) -> DataFrame:
    """(key, doc, tag, lead) for each bucket of each document, and one row a document with the tag -1 - set size.

    ``lead`` is null for the only member of a bucket within a batch, else the batch's first member of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags, docs_, counts, n = [], [], [], [], 0
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = shingle_hashes(text)
                bands = bands_of(len(hashes)) if len(hashes) else []
                parts = [signatures(hashes, band, i == 1, deletions) for i, band in enumerate(bands)]
                keys += [mix(np.array([doc], np.int64).view(np.uint64)).view(np.int64), *[p[0] for p in parts]]
                tags += [np.array([-1 - len(hashes)]), *[p[1] for p in parts]]
                docs_.append(doc)
                counts.append(1 + sum(len(p[0]) for p in parts))
                n += counts[-1]
                if n > BLOCK_ROWS:
                    yield from _rows(keys, tags, docs_, counts)
                    keys, tags, docs_, counts, n = [], [], [], [], 0
            if keys:
                yield from _rows(keys, tags, docs_, counts)

    return map_batches(docs, run, "key long, doc long, tag long, lead long")


def _rows(keys: list, tags: list, docs: list, counts: list) -> Iterator[pa.RecordBatch]:
    key, tag = np.concatenate(keys), np.concatenate(tags).astype(np.int64)
    doc = np.repeat(np.array(docs, np.int64), counts)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(start) - 1
    lead, alone = np.empty_like(doc), np.empty(len(doc), bool)
    lead[order] = doc[order][np.flatnonzero(start)][group]
    alone[order] = (np.bincount(group) == 1)[group]
    table = pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(tag), pa.array(lead, mask=alone)],
                                       names=["key", "doc", "tag", "lead"])
    yield from (table.slice(i, 200_000) for i in range(0, len(key), 200_000))


def _with_text(pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, text_a, text_b) and the table of ids that it reads; only texts of documents in pairs leave the scan, as long as their ids are few."""
    ids = materialize(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(),
                      "compare-ids")
    texts = docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc")
    return (pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")), ids


def verified(pairs: DataFrame, docs: DataFrame, percent: int = 80) -> DataFrame:
    """Those pairs (a, b) of ``docs`` (doc, text) whose shingle sets reach the similarity, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if text_b != last:  # rows of one representative follow one another
                    last, known = text_b, shingles(text_b)
                keep.append(similar(shingles(text_a), known, percent))
            ids = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield ids.filter(pa.array(keep, pa.bool_()))

    texts, ids = _with_text(pairs, docs)
    found = materialize(map_batches(texts.select("a", "b", "text_a", "text_b"), run, "a long, b long"), "verified")
    drop_table(ids)
    return found


def _shared_rows(docs: DataFrame, deletions: bool = False) -> DataFrame:
    """The rows (key, doc, tag, rep) of buckets that several documents share, and those of the sets' sizes.

    A batch's later members of a bucket are known to share it, and are dealt out by themselves.
    """
    rows = signature_rows(docs, deletions)
    later = F.col("lead") != F.col("doc")
    bucket = Window.partitionBy(F.when(later, F.xxhash64("key", "doc", "tag")).otherwise(F.col("key")))
    counted = rows.select("*", F.count(F.lit(1)).over(bucket).alias("n"), F.min("doc").over(bucket).alias("first"))
    return materialize(counted.filter("tag < 0 or lead is not null or n > 1").select(
        "key", "doc", "tag", F.when(later, F.col("lead")).otherwise(F.col("first")).alias("rep")), "buckets")


def _weighed(rows: DataFrame) -> DataFrame:
    """(doc, below, segment) of the rows with the weight of an agreement there, and the weight to spare."""
    facts = rows.select("doc", F.expr(_BELOW).alias("below"), F.expr(_SEGMENT).alias("segment"), F.expr(_SPARE).alias("spare"),
                        F.expr(_WEIGHT).alias("weight"))
    return facts.repartition("doc").groupBy("doc", "below", "segment", "spare").agg(F.max("weight").alias("weight"))


def _still_open(rows: DataFrame, deletions: bool = False) -> DataFrame:
    """The rows of those documents, by band, whose agreements weigh more than what is to spare."""
    weight = F.sum("weight") if deletions else F.count(F.lit(1))
    some = (_weighed(rows).groupBy("doc", "below", "spare").agg(weight.alias("all_weight"))
            .filter("all_weight > spare").select("doc", "below"))
    return rows.withColumn("below", F.expr(_BELOW)).join(some, ["doc", "below"], "left_semi").drop("below")


def _labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows with the label of their document: its component's, or at first its own."""
    rows = rows.drop("label", "rep")
    if label is None:
        return rows.withColumn("label", F.col("doc"))
    side = F.broadcast(label) if label.count() <= MOST_BROADCAST else label
    return (rows.join(side.select(F.col("id").alias("doc"), "component"), "doc", "left")
            .withColumn("label", F.coalesce("component", "doc")).drop("component"))


def _apart(rows: DataFrame) -> DataFrame:
    """The labelled rows (key, doc, label, ...) of buckets with several labels."""
    ends = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return rows.join(ends.select("key"), "key", "left_semi")


def _best_pairs(rows: DataFrame) -> DataFrame:
    """Each document, by band, with the representative that it shares most rows with: (a, b), a > b."""
    best = (rows.filter("rep <> doc").groupBy("doc", F.expr(_BELOW).alias("below"), "rep").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("doc", "below").agg(F.max(F.struct("n", (-F.col("rep")).alias("minus"))).alias("top")))
    rep = -F.col("top.minus")
    return best.select(F.greatest("doc", rep).alias("a"), F.least("doc", rep).alias("b")).distinct()


def _allocated(rows: DataFrame) -> DataFrame:
    """Of shingle rows (key, doc, size, label) those that a set does not pass over, with their ``place`` in its order.

    A set has 4 / 5 of its shingles in common with a partner at least, so it passes over one less of the costliest.
    All sets order shingles alike, the costliest first: what a pair has in common ends with a shingle that neither passes over,
    and the pair has no more in common than that shingle's place in either.
    """
    cost = rows.groupBy("key").agg(F.count(F.lit(1)).alias("cost"))
    ordered = Window.partitionBy("doc").orderBy(F.desc("cost"), "key")
    placed = rows.join(cost, "key").withColumn("place", F.row_number().over(ordered))
    return _apart(placed.filter("5 * place >= 4 * size").drop("cost"))


def _meetings(rows: DataFrame) -> int:
    """How many pairs of different labels meet in all buckets."""
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    pairs = by_label.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    return int(pairs.agg(F.sum("pairs")).first()[0] or 0)


def _allocated_pairs(rows: DataFrame, parity: DataFrame) -> DataFrame:
    """Candidates (a, b), a > b, of allocated rows: those that meet in a bucket where they may have enough in common,
    and whose ``parity`` differs in no more segments than they may differ in elements."""
    names = [f"parity_{i}" for i in range(PARITIES)]
    rows = rows.select("key", "doc", "size", "label", "place").join(parity, "doc")
    left, right = rows.alias("l"), rows.alias("r")
    differ = " + ".join(f"bit_count(l.{p} ^ r.{p})" for p in names)
    may = ("l.doc > r.doc and l.label <> r.label and 9 * least(l.place, r.place) >= 4 * (l.size + r.size) "
           f"and 9 * ({differ}) <= l.size + r.size")
    return (left.join(right, (F.col("l.key") == F.col("r.key")) & F.expr(may))
            .select(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).distinct())


def link_similar(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (doc, text), distinct ids: the sizes (doc, size) and verified links (a, b).

    The links join every component; not every link within a component is listed.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    shared = _shared_rows(docs)
    sizes = materialize(shared.filter("tag < 0").select("doc", (-1 - F.col("tag")).alias("size")).distinct(), "sizes")
    rows = materialize(_still_open(shared.filter("tag >= 0")), "open-rows")
    drop_table(shared)
    pairs = materialize(_sized(_best_pairs(rows), sizes), "stars")
    links = verified(pairs, docs, percent)
    drop_table(pairs)
    label = connected_components(links)
    ids = materialize(_still_open(_apart(_labelled(rows, label))).select("doc").distinct(), "open-ids")
    drop_table(rows)
    # Every shingle a segment of its own.
    fine, before, stale = materialize(shingle_rows(_only(docs, ids)), "shingle-rows"), None, True
    for turn in itertools.count():
        last, fine = fine, materialize(_feasible(_labelled(fine, label) if stale else fine), "shingle-rows")
        drop_table(last)
        now = fine.count()
        if now == 0:
            return sizes, links
        met = materialize(_allocated(fine), "allocated")
        if ROWS_A_MEETING * _meetings(met) <= now or before is not None and now > 0.9 * before and 4 * new <= tried:
            break
        drop_table(met)
        pairs = materialize(_sized(_hub_pairs(fine, turn), sizes), "stars")
        found = verified(pairs, docs, percent)
        new, tried = found.count(), pairs.count()
        drop_table(pairs)
        stale = new > 0
        if stale:
            links = materialize(links.unionByName(found), "links")
            label = connected_components(links)
        before = now
    drop_table(fine)
    # What would still meet others, with one-deletion neighbourhoods.
    ids = materialize(met.select("doc").distinct(), "open-ids")
    near = _shared_rows(_only(docs, ids), deletions=True)
    ids = materialize(_still_open(_apart(_labelled(near.filter("tag >= 0"), label)), deletions=True).select("doc").distinct(), "open-ids")
    drop_table(near)
    parity = materialize(parity_rows(_only(docs, ids)), "parities")
    pairs = materialize(_allocated_pairs(met, parity), "more-pairs")
    drop_table(met, parity)
    return sizes, links.unionByName(verified(pairs, docs, percent))


def _feasible(rows: DataFrame) -> DataFrame:
    """The shingle rows that a partner may share, of documents that may have one.

    A pair has 4 / 9 of both sizes in common at least.  A shingle's partners are no smaller than the smallest document
    that has it, so that size and the document's own bound what must be in common; documents that have not so much in
    common with those of other labels go.
    """
    rows = rows.select("key", "doc", "size", "label")
    ends = (rows.groupBy("key").agg(F.min("size").alias("other"), F.min("label").alias("low"), F.max("label").alias("high"))
            .filter("low < high").select("key", "other"))
    of_doc = Window.partitionBy("doc")
    common = F.count(F.lit(1)).over(of_doc)
    near = rows.join(ends, "key").withColumn("common", common).filter("4 * (size + other) <= 9 * common")
    enough = near.withColumns({"common": common, "least": F.min("other").over(of_doc)}).filter("4 * (size + least) <= 9 * common")
    return enough.select("key", "doc", "size", "label")


def _hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each document with the one of its shingles' hubs that it has most in common with: (a, b), a > b.

    A shingle's hub is the smallest set that has it, in later turns one by chance.
    """
    rank = F.col("size") if turn == 0 else F.xxhash64(F.lit(turn), "label", "doc")
    hubs = rows.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("doc").alias("rep"), F.col("label").alias("rep_label"))).alias("hub"))
    met = rows.join(hubs, "key").filter("label <> hub.rep_label").groupBy("doc", F.col("hub.rep").alias("rep")).agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("doc").agg(F.max(F.struct("n", (-F.col("rep")).alias("minus"))).alias("top"))
    rep = -F.col("top.minus")
    return best.select(F.greatest("doc", rep).alias("a"), F.least("doc", rep).alias("b")).distinct()


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc", "left_semi")


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 ``PARITIES`` segments of the universe: whether the set has an odd number of elements there."""
    segment = (hashes % np.uint64(64 * PARITIES)).astype(np.int64)
    return np.packbits(np.bincount(segment, minlength=64 * PARITIES) % 2 == 1).view(np.int64)


def parity_rows(docs: DataFrame) -> DataFrame:
    """(doc, parity_0, ...): the parities of each document's set.

    Two sets differ in at least as many elements as there are segments of different parity.
    """
    names = [f"parity_{i}" for i in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, PARITIES), np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                found[i] = parities(shingle_hashes(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c) for c in found.T]], names=["doc", *names])

    return map_batches(docs, run, ", ".join(["doc long", *[f"{n} long" for n in names]]))


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(key, doc, size) for each distinct shingle of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = shingle_hashes(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(hashes), doc, np.int64)),
                                                  pa.array(np.full(len(hashes), len(hashes), np.int64))], names=["key", "doc", "size"])

    return map_batches(docs, run, "key long, doc long, size long").distinct()


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Only pairs whose sizes allow the similarity."""
    of = lambda c: sizes.select(F.col("doc").alias(c), F.col("size").alias(f"size_{c}"))
    return (pairs.join(of("a"), "a").join(of("b"), "b")
            .filter("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)").select("a", "b"))


def _with_body(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, text, body): the id as a long, the text and its hash."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).select(
        "doc", "text", F.md5(F.col("text").cast("binary")).alias("body"))


def _members(docs: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """(doc, body, rep, number, size, component, component_id), one row per row of ``docs``.

    ``number`` is the text's own: the smallest id that has it, or a negative one where an id is the smallest of several texts.
    """
    given = _with_body(docs, text, doc_id)
    hashed = materialize(given.select("doc", "body"), "text-hashes")
    smallest = hashed.filter("doc is not null").groupBy("body").agg(F.min("doc").alias("rep"))
    several = smallest.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    own = -1 - F.xxhash64("body").bitwiseAND((1 << 62) - 1)
    numbers = materialize(smallest.join(several, "rep", "left").select(
        "body", "rep", F.when(F.col("texts").isNull(), F.col("rep")).otherwise(own).alias("number")), "text-numbers")
    odd = materialize(numbers.filter("number < 0 and number <> rep").select(F.col("rep").alias("doc"), "body", "number"), "odd-numbers")
    owners = materialize(hashed.join(numbers, "body", "left"), "text-owners")
    # Ids that are the smallest of no text have copies only.
    spare = materialize(owners.filter("doc is not null").groupBy("doc").agg(F.max((F.col("doc") == F.col("rep")).cast("int")).alias("goes"))
                        .filter("goes = 0").select("doc"), "text-copies")
    texts = given.filter("doc is not null").join(
        F.broadcast(spare) if spare.count() <= MOST_BROADCAST else spare, "doc", "left_anti")
    if odd.count():  # rows of an id with several texts
        several_of = odd.select("doc", "body", "number")
        texts = texts.join(several_of, ["doc", "body"], "left").withColumn("doc", F.coalesce("number", "doc"))
    sizes, links = link_similar(texts.select("doc", "text"), percent)
    label = connected_components(links).select(F.col("id").alias("number"), "component")
    out = (numbers.join(sizes.select(F.col("doc").alias("number"), "size"), "number", "left").join(label, "number", "left")
           .withColumn("component", F.coalesce("component", "number")))
    out = materialize(out, "text-components")
    worded = out.filter("size > 0")
    lowest = worded.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = worded.join(lowest, "component").select("body", "rep", "number", "size", "component", "component_id")
    return owners.select("doc", "body").join(found, "body", "left")


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (the smallest doc_id reachable)."""
    rows = _members(docs, text, doc_id, percent)
    return rows.select(F.col("doc").alias("doc_id"),
                       F.when(F.col("doc").isNull(), 0).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("n_shingles"),
                       F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: one with its smallest id; of the texts of that id the one with the smallest number.

    Rows with a null id, and rows without words, stay; of repeated rows of such an id and text one stays, too.
    Only ids and hashes of texts are compared and joined; those that go are broadcast as long as they are few.
    """
    rows = materialize(_members(docs, text, doc_id, 80), "members").filter("doc is not null")
    chosen = rows.filter("doc = component_id").groupBy("component").agg(F.min("number").alias("chosen"))
    judged = rows.join(chosen, "component", "left").groupBy("doc", "body").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.when(F.col("size").isNotNull() & ~((F.col("doc") == F.col("component_id")) & (F.col("number") == F.col("chosen"))), 1)
              .otherwise(0)).alias("goes"))
    special = materialize(judged.filter("goes = 1 or rows > 1").select(
        F.col("doc").alias("special_doc"), F.col("body").alias("special_body"), "goes"), "special-rows")
    side = F.broadcast(special) if special.count() <= MOST_BROADCAST // 4 else special
    of = ((docs[f"`{doc_id}`"].cast("long") == side["special_doc"])
          & (F.md5(F.coalesce(docs[f"`{text}`"], F.lit("")).cast("binary")) == side["special_body"]))
    repeated = docs.join(side.filter("goes = 0"), of, "left_semi").dropDuplicates([doc_id, text])
    return docs.join(side, of, "left_anti").unionByName(repeated)
