"""Operator 12, periodic runs of words by a Re-Pair grammar.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words
and two periods long, that no neighbouring word extends keeping the period.  In each
document:

* *Zones.*  All words of a run lie in windows of six words that stand twice (the words
  q apart), so only stretches of such windows, and within them all words, are parsed.
  A run lies within one zone, and its neighbours outside do not extend it.
* *Re-Pair.*  The word ids of a zone are compressed: the most frequent pair becomes a
  nonterminal, until no pair occurs twice; among pairs of one frequency the one met first
  goes first, which keeps the derivation shallow.  What is left is paired up evenly.
* *Runs at boundaries.*  For each nonterminal X -> Y Z, once, however often X occurs: the
  stretches with a period that cross the boundary between the expansions of Y and Z, from
  the longest common extensions of all shifts (Z-functions).
* *Positions.*  The runs of a nonterminal are translated to every place where it occurs in the derivation.
  The whole of a run is found where the lowest nonterminal holds it; parts of
  it found below are merged into it, and stretches whose period is not the smallest go.

Spark deals out the documents; nothing is shuffled or kept between tasks.  Work and memory of a
document follow its own length (times its logarithm).

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text;
repeated rows are treated alike and all returned; an empty table gives an empty
result.  Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.llm.common import map_batches, space_words

#: Least length of a run in words.
LEAST = 12
#: Words of the windows that stand twice in a run: at least half of the shortest run.
WINDOW = LEAST // 2

Run = tuple[int, int, int]  # start, length, period


def zones(words: list) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) of words in windows that stand twice."""
    n = len(words)
    if n < LEAST:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):  # equal windows have equal sums; others hardly ever, which costs time only
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + len(window)]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return []
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cuts = np.flatnonzero(np.diff(at) > WINDOW) + 1  # windows that touch belong together
    return [(int(part[0]), int(part[-1]) + WINDOW) for part in np.split(at, cuts)
            if part[-1] + WINDOW - part[0] >= LEAST]


def repair(ids: list[int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Re-Pair: the symbols that are left, and the rules nonterminal -> pair."""
    n, fresh = len(ids), max(ids, default=-1) + 1
    symbol: list[int] = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        places.setdefault((ids[i], ids[i + 1]), set()).add(i)
    met = {p: k for k, p in enumerate(places)}
    heap = [(-len(at), met[p], p) for p, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: dict[int, tuple[int, int]] = {}
    while heap:
        count, _, pair = heapq.heappop(heap)
        at = places.get(pair, set())
        if len(at) != -count:
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), met[pair], pair))
            continue
        chosen, end = [], -1
        for i in sorted(at):  # occurrences that do not overlap, from the left
            if i >= end:
                chosen.append(i)
                end = after[after[i]] if after[i] < n else n
        if len(chosen) < 2:
            del places[pair]
            continue
        rules[fresh], new = pair, set()
        for i in chosen:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0:
                places.get((symbol[left], symbol[i]), set()).discard(left)
            if right < n:
                places.get((symbol[j], symbol[right]), set()).discard(j)
            symbol[i], after[i] = fresh, right
            if right < n:
                before[right] = i
                key = (fresh, symbol[right])
                places.setdefault(key, set()).add(i)
                new.add(key)
            if left >= 0:
                key = (symbol[left], fresh)
                places.setdefault(key, set()).add(left)
                new.add(key)
        places.pop(pair, None)
        for key in sorted(new):
            if len(places.get(key, ())) > 1:
                met.setdefault(key, len(met))
                heapq.heappush(heap, (-len(places[key]), met[key], key))
        fresh += 1
    rest, i = [], 0
    while i < n:
        rest.append(symbol[i])
        i = after[i]
    return rest, rules


def z_function(s: list[int]) -> list[int]:
    """For each place, how long what starts there agrees with the beginning."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(0, right - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def boundary_runs(y: list[int], z: list[int]) -> list[Run]:
    """Stretches with a period, two periods and ``LEAST`` long, across the boundary between y and z."""
    found = set()
    a, b = len(y), len(z)
    if a + b < LEAST:
        return []
    text = y + z
    # Shifts with a whole period to the right of the boundary, and those with one to the left.
    forward = z_function(z)
    to_left = z_function(y[::-1] + [-1] + text[::-1])[a + 1:]  # how far y's end agrees with what ends at a place
    for q in range(1, b + 1):
        ahead = forward[q] if q < b else 0
        back = min(to_left[b - q], a)
        length = q + ahead + back
        if length >= 2 * q and length >= LEAST and back > 0:
            found.add((a - back, length, q))
    backward = z_function(y[::-1])
    to_right = z_function(z + [-1] + text)[b + 1:]
    for q in range(1, a + 1):
        back = backward[q] if q < a else 0
        ahead = min(to_right[a - q], b)
        length = q + ahead + back
        if length >= 2 * q and length >= LEAST and ahead > 0:
            found.add((a - q - back, length, q))
    return list(found)


def zone_runs(words: list) -> list[Run]:
    """All runs of a zone."""
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    rest, rules = repair(ids)
    fresh = max([len(number) - 1, *rules]) + 1
    level = rest
    while len(level) > 1:  # what is left is paired up evenly, equal pairs under one name
        names: dict[tuple[int, int], int] = {}
        up = []
        for i in range(0, len(level) - 1, 2):
            pair = (level[i], level[i + 1])
            if pair not in names:
                names[pair] = fresh
                rules[fresh] = pair
                fresh += 1
            up.append(names[pair])
        level = up + level[len(up) * 2:]
    size = dict.fromkeys(range(len(number)), 1)
    for x, (y, z) in rules.items():  # a rule's parts come before it
        size[x] = size[y] + size[z]
    # From the top down: where each nonterminal occurs, every place once; its expansion is read at the first.
    starts: dict[int, list[int]] = {level[0]: [0]} if level else {}
    intervals: set[Run] = set()
    for x in sorted(rules, reverse=True):
        at = starts.pop(x, [])
        if not at:
            continue
        y, z = rules[x]
        starts.setdefault(y, []).extend(at)
        starts.setdefault(z, []).extend([i + size[y] for i in at])
        if size[x] >= LEAST:
            first, middle = at[0], at[0] + size[y]
            for start, length, q in boundary_runs(ids[first:middle], ids[middle:first + size[x]]):
                intervals.update((i + start, length, q) for i in at)
    return _maximal(intervals)


def _maximal(intervals: set[Run]) -> list[Run]:
    """Parts of one run merged, and only the smallest period of a stretch."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for start, length, q in intervals:
        by_period.setdefault(q, []).append((start, start + length))
    best: dict[tuple[int, int], int] = {}
    for q, spans in by_period.items():
        spans.sort()
        start, end = spans[0]
        merged = []
        for s, e in spans[1:]:
            if s <= end - q:  # an overlap of a period: one stretch
                end = max(end, e)
            else:
                merged.append((start, end))
                start, end = s, e
        for span in [*merged, (start, end)]:
            best[span] = min(q, best.get(span, q))
    return sorted((s, e - s, q) for (s, e), q in best.items())


def word_runs(words: list) -> list[Run]:
    """All runs of a sequence of words, by start, then period."""
    out = []
    for start, end in zones(words):
        out += [(start + s, length, q) for s, length, q in zone_runs(words[start:end])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d] if runs else words


def find_runs(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period) and the collapsed text of every row."""
    runs = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))

    def make(words: list[bytes], found: list[Run]) -> tuple:
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], b" ".join(collapsed(words, found)).decode()

    return _over_rows(docs, text, doc_id, {"runs": runs, "collapsed": T.StringType()}, make,
                      [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()])


def run_digests(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row the number of runs, the longest one, and the SHA-256 of all runs and of the collapsed text."""

    def make(words: list[bytes], found: list[Run]) -> tuple:
        start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        return (len(found), start, length, q, 1000 * length // q if found else None,
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())

    numbers = ("n_runs", "start", "length", "period", "exponent_milli")
    columns = {**dict.fromkeys(numbers, T.LongType()), "runs_sha256": T.StringType(), "collapsed_sha256": T.StringType()}
    return _over_rows(docs, text, doc_id, columns, make, [pa.int64()] * 5 + [pa.string()] * 2)


def _over_rows(docs: DataFrame, text: Column | str, doc_id: str, columns: dict[str, T.DataType], make, types: list) -> DataFrame:
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                        (F.col(f"`{text}`") if isinstance(text, str) else text).alias("body"))
    schema = T.StructType([given.schema["doc_id"], *[T.StructField(k, t) for k, t in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("body"):
                words = (value.as_py() or "").encode().split()  # of bytes: ASCII white space only
                rows.append(make(words, word_runs(words)))
            cells = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells], names=["doc_id", *columns])

    return map_batches(given, run, schema)


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """Texts of a tenth of the documents, by the checksum of the id, made periodic from some word on.

    With h the checksum and g = floor(h / 10): if h % 10 = 0, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def moved(words: Column) -> Column:
        n = F.size(words)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i)), " "))

    # The words are bound once, as the element of an array; only chosen rows are split.
    bound = F.transform(F.array(space_words(F.coalesce(text, F.lit("")))), moved)
    return F.when(h % 10 == 0, F.get(bound, F.lit(0))).otherwise(text)
