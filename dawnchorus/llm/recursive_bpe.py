"""Operator 6, byte-level BPE encoding and decoding by recursive queries in DuckDB.

Spark deals out the documents; each task cuts its texts into pieces and gives every
piece that it has not met before to an in-process DuckDB as token-position rows.
There a recursive query joins the positions to the merge table, contracts each
word's leftmost pair of the lowest rank and goes on until no pair is left.  An
ordered aggregation over the tokens gives the bytes back.

Memory is bounded: texts are worked on in blocks, words in blocks of ``WORDS``, and
the table of pieces known to a task is cleared when it exceeds ``KNOWN`` entries.
Nothing is kept between tasks, so a lost task is simply run again.

One contraction a round makes the recursion as deep as the longest word, so pieces
over ``LONG`` bytes are merged with a heap instead, by the same rule.

Defined results: a null or empty text has no tokens; repeated rows are encoded
alike and all returned; an empty table gives an empty result.  Other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.llm.common import map_batches

WORDS = 20_000
KNOWN = 200_000
BLOCK_CHARS = 28_000_000
ROWS = 500
LONG = 96

#: Unicode white space, as a character-class body.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the split pattern crosses from one of these units into the next:
#: a run of other characters with the space before it, or white space.
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")

FIXPOINT = """
WITH RECURSIVE state(word, tokens, step) AS (
  SELECT word, tokens, 0 FROM words
  UNION ALL
  SELECT s.word, s.tokens[:best.pos - 1] || [best.rank] || s.tokens[best.pos + 2:], step + 1
  FROM state s JOIN (
    SELECT word, min(rank) AS rank, min(rank * 1048576 + pos) % 1048576 AS pos
    FROM (SELECT word, pos, tokens[pos] * 65536 + tokens[pos + 1] AS pair
          FROM (SELECT word, tokens, unnest(range(1, len(tokens))) AS pos FROM state))
    JOIN merges USING (pair) GROUP BY word) best USING (word)),
encoded AS (SELECT word, arg_max(tokens, step) AS tokens FROM state GROUP BY word)"""

DECODED = """
SELECT word, unhex(string_agg(hex, '' ORDER BY pos)) AS decoded
FROM (SELECT word, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM encoded)
JOIN vocabulary USING (token) GROUP BY word"""

ENCODE_SQL = f"{FIXPOINT} SELECT word, tokens FROM encoded ORDER BY word"
DECODE_SQL = f"WITH encoded AS (FROM words) {DECODED} ORDER BY word"
TRANSLATE_SQL = f"""{FIXPOINT}, bytes AS ({DECODED})
SELECT array_to_string(tokens, ',') AS ids, len(tokens) AS n, decoded FROM encoded JOIN bytes USING (word) ORDER BY word"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes pieces; lives in one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        if max(ranks.values()) >= 65536:
            raise ValueError("pairs of tokens are packed into 32 bits: ranks are below 65536")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.merges = {
            ranks[token[:i]] * 65536 + ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self._table("merges", pair=pa.array(self.merges.keys(), pa.int64()), rank=pa.array(self.merges.values(), pa.int64()))
        self._table("vocabulary", token=pa.array(ranks.values(), pa.int64()), hex=pa.array([t.hex() for t in ranks]))
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, sql: str, tokens: list[list[int]]) -> pa.Table:
        """Run a query over words given as lists of tokens; its rows come in their order."""
        self._table("words", word=pa.array(range(len(tokens)), pa.int64()), tokens=pa.array(tokens, pa.list_(pa.int64())))
        return self.db.sql(sql).to_arrow_table()

    def _start(self, word: bytes) -> list[int]:
        """Where the recursion starts: a word of the vocabulary is one token, any other its bytes."""
        if word in self.ranks:
            return [self.ranks[word]]
        return [self.first[b] for b in word] if len(word) <= LONG else self._merge_long(word)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word, by the recursive query in blocks of words."""
        out: list[list[int]] = []
        for i in range(0, len(words), WORDS):
            out += self._ask(ENCODE_SQL, [self._start(w) for w in words[i:i + WORDS]])["tokens"].to_pylist()
        return out

    def decode_words(self, tokens: list[list[int]]) -> list[bytes]:
        """Bytes of each list of tokens, by ordered aggregation in blocks."""
        out: list[bytes] = []
        for i in range(0, len(tokens), WORDS):
            found = self._ask(DECODE_SQL, tokens[i:i + WORDS])
            by_word = dict(zip(found["word"].to_pylist(), found["decoded"].to_pylist(), strict=True))
            out += [by_word.get(j, b"") for j in range(len(tokens[i:i + WORDS]))]
        return out

    def translate_words(self, words: list[bytes]) -> Iterator[tuple[str, int, bytes]]:
        """For each word its ids as text, how many, and the bytes that they decode to."""
        for i in range(0, len(words), WORDS):
            found = self._ask(TRANSLATE_SQL, [self._start(w) for w in words[i:i + WORDS]])
            yield from zip(*(found[c].to_pylist() for c in ("ids", "n", "decoded")), strict=True)

    def _merge_long(self, word: bytes) -> list[int]:
        """The same rule for one long word: a heap of its pairs by rank and place."""
        tokens: list[int | None] = [self.first[b] for b in word]
        end = len(tokens)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))

        def pair(i: int) -> tuple[int, int, int] | None:
            key = tokens[i] * 65536 + tokens[after[i]] if i >= 0 and after[i] < end else -1
            return (self.merges[key], i, key) if key in self.merges else None

        heap = [p for p in map(pair, range(end)) if p]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            if tokens[i] is None or pair(i) != (rank, i, key):
                continue  # one of its tokens has been merged since
            gone = after[i]
            tokens[i], tokens[gone], after[i] = rank, None, after[gone]
            if after[i] < end:
                before[after[i]] = i
            for p in (pair(before[i]), pair(i)):
                if p:
                    heapq.heappush(heap, p)
        return [t for t in tokens if t is not None]

    def learn(self, units: Iterable[str]) -> None:
        """Translate units that are not known yet, by their pieces."""
        new = [u for u in units if u not in self.known]
        pieces = {u: [u] if u.lstrip(" ").isalpha() and u.rfind(" ") < 1 else self.split(u) for u in new}
        words = list(dict.fromkeys(p for ps in pieces.values() for p in ps))
        found = dict(zip(words, self.translate_words([w.encode() for w in words]), strict=True))
        for u, ps in pieces.items():
            if len(ps) == 1:
                self.known[u] = found[ps[0]]
            else:
                ids, sizes, decoded = zip(*[found[p] for p in ps], strict=True)
                self.known[u] = ",".join(ids), sum(sizes), b"".join(decoded)

    def texts(self, texts: list[str], block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], tuple[bytes, ...]]]:
        """For each text, of its units: the ids as text, how many they are, the decoded bytes."""
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size <= block_chars:
                size += len(texts[stop])
                stop += 1
            units = [UNIT.findall(t) for t in texts[start:stop]]
            if len(self.known) > KNOWN:
                self.known.clear()
            self.learn(set().union(*units))
            for u in units:
                yield tuple(zip(*map(self.known.__getitem__, u), strict=True)) if u else ((), (), ())
            start = stop


def _over_batches(docs: DataFrame, text: str, doc_id: str, vocabulary: str, pattern: str,
                  columns: dict[str, T.DataType], work) -> DataFrame:
    """``work(codec, values)`` yields the columns of consecutive rows, some hundreds at a time."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    schema = T.StructType([given.schema["doc_id"], *[T.StructField(k, t) for k, t in columns.items()]])
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            start = 0
            for found in work(codec, batch.column("body").to_pylist()):
                rows = len(found[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, rows), *found],
                                                 names=["doc_id", *columns])
                start += rows

    return map_batches(given, run, schema)


def _id_lists(ids: list[str], sizes: list[int]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.array(",".join(filter(None, ids)).split(",") if sum(sizes) else [], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int) of each row's whole text, and whether they decode to the text's bytes."""

    def work(codec: Codec, texts: list) -> Iterator[list[pa.Array]]:
        bodies = [t or "" for t in texts]
        coded = codec.texts(bodies, BLOCK_CHARS // 4)  # the lists of ids need room, too
        for start in range(0, len(bodies), ROWS):
            ids, sizes, same = [], [], []
            for body, (texts_of, sizes_of, decoded) in zip(bodies[start:start + ROWS], coded, strict=False):
                ids.append(",".join(texts_of))
                sizes.append(sum(sizes_of))
                same.append(b"".join(decoded) == body.encode())
            yield [_id_lists(ids, sizes), pa.array(same, pa.bool_())]

    columns = {"ids": T.ArrayType(T.IntegerType()), "round_trip": T.BooleanType()}
    return _over_batches(docs, text, doc_id, vocabulary, pattern, columns, work)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids",
                     doc_id: str = "doc_id") -> DataFrame:
    """doc_id and bytes (binary) of each row's ids; null ids give no bytes."""

    def work(codec: Codec, rows: list) -> Iterator[list[pa.Array]]:
        for start in range(0, len(rows), ROWS):
            yield [pa.array(codec.decode_words([r or [] for r in rows[start:start + ROWS]]), pa.binary())]

    return _over_batches(encoded, ids, doc_id, vocabulary, pattern, {"bytes": T.BinaryType()}, work)


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text",
                       doc_id: str = "doc_id") -> DataFrame:
    """Encode, decode, and return per row doc_id, n_tokens and the SHA-256 of ids and decoded bytes."""

    def work(codec: Codec, texts: list) -> Iterator[list[pa.Array]]:
        sizes, ids, decoded = [], [], []
        for texts_of, sizes_of, bytes_of in codec.texts([t or "" for t in texts]):
            sizes.append(sum(sizes_of))
            ids.append(hashlib.sha256(",".join(texts_of).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(bytes_of)).hexdigest())
        yield [pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    columns = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _over_batches(docs, text, doc_id, vocabulary, pattern, columns, work)
