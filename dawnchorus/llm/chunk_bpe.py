"""Operator 11, BPE encoding and decoding that reuses content-defined chunks.

Texts are cut where a rolling hash of the last ``REACH`` bytes says so, so what
documents share is cut alike in each of them.  The inside of a chunk, from its first to
its last white space, is encoded once however many texts hold it:

1. Every distinct text gives the hashes of its chunks' insides; a grouped minimum and
   maximum of the texts' keys tells which chunks several texts share, and names the one
   text that owns each of them.
2. Each text is encoded where it stands: its own chunks, those that it owns (which are
   also written for the others) and the joins.  Chunks of another owner stay references.
3. References are joined to the owners' ids; texts are put together in order.

*Joins.*  Chunks end anywhere, also within a word, a special token or a run of combining
marks.  So a join is encoded anew: the window from the last word before the cut to the
first word after it, wider by a word on each side until the widening words get the very ids that they
had.  A chunk without white space is all window, and joins the next one.  White space ends
every match of the vocabulary's pattern and every normalisation, so agreement there is
agreement of the whole text; ``tests/llm`` holds all ids against the library.

Texts move once, by the key of the text (copies are merged before); of ids only
those of texts with shared chunks move.  A chunk that very many texts hold is a hot key of the
join with references only, which the adaptive skew join splits.  A worker keeps the ids of
at most ``KNOWN`` words, from task to task.

Defined results: a null or empty text has no ids and decodes to the empty string;
repeated rows are all returned; an empty table gives an empty result.  Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.llm.common import drop_table, map_batches, materialize

#: Bytes that the rolling hash sees.
REACH = 24
#: A cut stands after one of so many bytes, in the mean.
MEAN_CHUNK = 1024
#: Insides shorter than this are left to their texts: a reference is larger than their ids.
LEAST_INSIDE = 64
KNOWN = 500_000
SLAB = 1 << 16

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WHITE = b" \t\n\r\x0b\x0c"
_FIRST_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]").search


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(SLAB + REACH, base, np.uint64)]))


_UP = _powers(_MULTIPLIER)
_DOWN = _powers(pow(_MULTIPLIER, -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def chunk_ends(body: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Where the chunks of a UTF-8 text end, the end of the text included; never within a character."""
    given = np.frombuffer(body, np.uint8)
    limit = np.uint64((1 << 64) // mean)
    ends: list[int] = []
    for start in range(0, max(len(body) - REACH, 0), SLAB):
        part = given[start:start + SLAB + REACH]  # cuts after REACH bytes of it
        sums = np.cumsum(_TABLE[part] * _UP[:len(part)], dtype=np.uint64)
        rolled = (sums[REACH:] - sums[:-REACH]) * _DOWN[1:len(part) - REACH + 1]
        at = np.flatnonzero(rolled * np.uint64(0xD1B54A32D192ED03) < limit) + start + REACH + 1
        ends += at[at < len(body)].tolist()
    return [e for e in ends if body[e] & 0xC0 != 0x80] + [len(body)]


def inside(body: bytes, start: int, end: int) -> tuple[int, int]:
    """From the first to the last white space of a chunk; (end, end) where there are not two."""
    found = _FIRST_WHITE(body, start, end)
    first = found.start() if found else end
    last = max(body.rfind(bytes((w,)), first, end) for w in _WHITE)
    return (first, last) if last > first else (end, end)


def insides(body: bytes) -> Iterator[tuple[int, int]]:
    """The insides of a text's chunks that are long enough to be shared."""
    start = 0
    for end in chunk_ends(body):
        first, last = inside(body, start, end)
        if last - first >= LEAST_INSIDE:
            yield first, last
        start = end


def word_parts(word: bytes) -> list[bytes]:
    """A word without its closing marks, and these: no match holds both a letter and a mark.

    Words of ASCII letters alone are taken in lower case, as the vocabulary does.
    """
    core = word.rstrip(b".,;:!?")
    letters = core.isalpha()  # of bytes: ASCII only
    if not letters:
        last = core.decode()[-1:]
        if len(core) == len(word) or not (last.isalpha() and last < "\u0250"):
            return [word]
    elif len(core) == len(word):
        return [core.lower()]
    return [core.lower() if letters else core, word[len(core):]]


class Words:
    """Ids of words by the tokenizers library, each word asked for once; at most ``KNOWN`` words are kept."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = id_type(vocabulary)
        self.code = {"<u2": "H", "<u4": "I"}[self.type]
        self.known: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> bytes:
        """The packed ids of words that white space parts."""
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:  # some are asked for the first time
            new = set(words).difference(known)
            if len(known) > KNOWN:
                known.clear()
                new = set(words)
            split = {w: word_parts(w) for w in new}
            parts = list({p for ps in split.values() for p in ps}.difference(known))
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
            known.update((p, array(self.code, c.ids).tobytes()) for p, c in zip(parts, coded, strict=True))
            known.update((w, b"".join(map(known.__getitem__, ps))) for w, ps in split.items())
        return b"".join(map(known.__getitem__, words))

    def window(self, text: bytes) -> bytes:
        """The packed ids of a window, encoded as one text."""
        return array(self.code, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def repaired(self, left: list[bytes], join: bytes, right: list[bytes]) -> bytes:
        """Ids of ``join``, the text across one or more cuts, with the words beside it in the chunks.

        Encoded together with one more word on each side, until those words get the ids that they have.
        """
        for n in range(1, max(len(left), len(right)) + 1):
            before, after = left[max(len(left) - n, 0):], right[:n]
            ids, head, tail = self.window(b" ".join([*before, join, *after])), self.encode(before), self.encode(after)
            if ids.startswith(head) and ids.endswith(tail) and len(ids) >= len(head) + len(tail):
                return ids[len(head):len(ids) - len(tail)]
        if left or right:
            raise ValueError("white space does not part the words of this vocabulary")
        return self.window(join)


@lru_cache(maxsize=1)
def worker_words(vocabulary: str) -> Words:
    """The words that a worker knows, kept from task to task: most words of a task have been met before it."""
    return Words(vocabulary)


@lru_cache(maxsize=1)
def id_type(vocabulary: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    found = json.loads(vocabulary)
    most = max([*found["model"]["vocab"].values(), *[t["id"] for t in found.get("added_tokens", [])]])
    return "<u2" if most < 1 << 16 else "<u4"


def _key(body: bytes) -> tuple[int, int]:
    import xxhash

    high, low = np.frombuffer(xxhash.xxh3_128_digest(body), np.int64).tolist()
    return high, low


def chunk_keys(texts: DataFrame) -> DataFrame:
    """``texts`` (k1, k2, body) -> (h1, h2, k1, k2) for each distinct inside of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for k1, k2, value in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("body").cast(pa.binary()), strict=True):
                body = value.as_py()
                rows += [(*h, k1, k2) for h in {_key(body[a:b]) for a, b in insides(body)}]
            cells = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, i])) for i in range(4)],
                                             names=["h1", "h2", "k1", "k2"])

    return map_batches(texts, run, "h1 long, h2 long, k1 long, k2 long")


def encode_text(words: Words, body: bytes, shared: dict[tuple[int, int], bool]) -> Iterator[tuple[str, object, object]]:
    """A text's parts in order: ("ids", packed, None), ("of", key, None) for another text's chunk, and
    ("own", key, packed) for a chunk that is written for others (its ids are part of the text, too)."""
    join, left, met = b"", [], {}
    start = at = 0
    for end in chunk_ends(body):
        first, last = inside(body, start, end)
        start = end
        if last <= first:
            continue  # no white space, or one only: part of the window
        right = body[first:last].split()
        join = body[at:first]
        yield "ids", words.repaired(left, join, right) if join.strip(_WHITE) else b"", None
        key = _key(body[first:last]) if shared and last - first >= LEAST_INSIDE else None
        if key in shared and not shared[key]:
            yield "of", key, None
        elif key in shared:
            if key not in met:
                met[key] = words.encode(right)
                yield "own", key, met[key]
            yield "ids", met[key], None
        else:
            yield "ids", words.encode(right), None
        left, at = right, last
    yield "ids", words.repaired(left, body[at:], []) if body[at:].strip(_WHITE) else b"", None


class Digest:
    """Running digests of ids: number, SHA-256 of the ids as text and of the decoded text."""

    def __init__(self, spelt: tuple[list[bytes], list[bytes]]):
        self.spelt, self.n = spelt, 0
        self.hashes = [hashlib.sha256(), hashlib.sha256()]

    def add(self, ids: np.ndarray) -> None:
        listed = ids.tolist()
        for spelt, h in zip(self.spelt, self.hashes, strict=True):
            if self.n and listed:
                h.update(b" ")
            h.update(b" ".join(map(spelt.__getitem__, listed)))
        self.n += len(listed)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.hashes[0].hexdigest(), self.hashes[1].hexdigest()


@lru_cache(maxsize=1)
def spellings(vocabulary: str) -> tuple[list[bytes], list[bytes]]:
    """For each id its decimal text, and its token as the library decodes it.

    A vocabulary without a decoder joins its tokens by one space; others are refused.
    """
    found = json.loads(vocabulary)
    if found.get("decoder") is not None:
        raise ValueError("only vocabularies whose decoding joins the tokens by a space")
    token = {i: t for t, i in found["model"]["vocab"].items()} | {t["id"]: t["content"] for t in found.get("added_tokens", [])}
    ids = range(max(token) + 1)
    return [b"%d" % i for i in ids], [token.get(i, "").encode() for i in ids]


_DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
_PIECES = "k1 long, k2 long, seq int, h1 long, h2 long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _keyed(docs: DataFrame, text: str, *more) -> DataFrame:
    """The rows' texts with their 128-bit key."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.md5(body.cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return docs.select(*more, half(1).alias("k1"), half(17).alias("k2"), body.alias("body"))


def _pieces(texts: DataFrame, vocabulary, whole: bool) -> DataFrame:
    """What encoding where it stands gives of ``texts`` (k1, k2, body, shared).

    Texts of no other owner's chunks are finished (seq -1: their digests, or their ids if ``whole``);
    of others the runs of ids and references in order; chunks for others have no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, spelt = worker_words(vocabulary.value), spellings(vocabulary.value)
        schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[t])
                            for c, t in (x.split() for x in _PIECES.split(", "))])
        for batch in batches:
            rows, size = [], 0
            for k1, k2, value, found in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
                                            batch.column("body").cast(pa.binary()), batch.column("shared").to_pylist(), strict=True):
                shared = {(x["h1"], x["h2"]): x["own"] for x in found or []}
                seq, packed = 0, []
                for kind, a, b in encode_text(words, value.as_py(), shared):
                    if kind == "ids":
                        packed.append(a)
                    elif kind == "own":
                        rows.append((None, None, None, *a, b, None, None, None))
                        size += len(b)
                    else:
                        rows += [(k1, k2, seq, None, None, b"".join(packed), None, None, None), (k1, k2, seq + 1, *a, None, None, None, None)]
                        seq, packed = seq + 2, []
                ids = b"".join(packed)
                if seq or whole:
                    rows.append((k1, k2, seq if seq else -1, None, None, ids, None, None, None))
                else:
                    digest = Digest(spelt)
                    digest.add(np.frombuffer(ids, words.type))
                    rows.append((k1, k2, -1, None, None, None, *digest.row()))
                size += len(ids)
                if size > 8_000_000:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    return map_batches(texts, run, _PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                      schema=schema)


def _encoded_texts(docs: DataFrame, vocabulary, text: str, whole: bool) -> DataFrame:
    """Pieces of all distinct texts, written: finished ones, and with references resolved the others."""
    keyed = _keyed(docs, text)
    # Every text once; the copies of a task's rows are merged before the shuffle.
    chunks = materialize(chunk_keys(keyed).distinct(), "chunk-keys")
    owners = chunks.groupBy("h1", "h2").agg(F.min("k1").alias("owner"), F.max("k1").alias("last")).filter("owner < last")
    shared = (chunks.join(owners, ["h1", "h2"]).groupBy("k1", "k2")
              .agg(F.collect_list(F.struct("h1", "h2", (F.col("k1") == F.col("owner")).alias("own"))).alias("shared")))
    texts = keyed.groupBy("k1", "k2").agg(F.min("body").alias("body")).join(shared, ["k1", "k2"], "left")
    pieces = materialize(_pieces(texts, vocabulary, whole), "chunk-pieces")
    drop_table(chunks)
    return pieces


def _in_order(pieces: DataFrame) -> DataFrame:
    """The runs of ids of unfinished texts, those of other owners fetched, by text and place."""
    owned = pieces.filter("k1 is null").select("h1", "h2", "ids").dropDuplicates(["h1", "h2"])
    runs = pieces.filter("seq >= 0")
    fetched = runs.filter("h1 is not null").select("k1", "k2", "seq", "h1", "h2").join(owned, ["h1", "h2"])
    columns = ["k1", "k2", "seq", "ids"]
    return (runs.filter("h1 is null").select(*columns).unionByName(fetched.select(*columns))
            .repartition("k1", "k2").sortWithinPartitions("k1", "k2", "seq"))


def round_trip_digests(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode every row's text, decode the ids; doc_id, n_tokens and the SHA-256 of both."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    pieces = _encoded_texts(docs, shipped, text, whole=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt, kind = spellings(shipped.value), id_type(shipped.value)
        key, digest = None, None
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in batches:  # a text's runs follow one another, also across batches
            rows = []
            for k1, k2, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids"), strict=True):
                if (k1, k2) != key:
                    if digest:
                        rows.append((*key, *digest.row()))
                    key, digest = (k1, k2), Digest(spelt)
                digest.add(np.frombuffer(ids.as_py(), kind))
            if rows:
                yield _batch(rows, schema)
        if digest:
            yield _batch([(*key, *digest.row())], schema)

    finished = pieces.filter("seq = -1").select("k1", "k2", *_DIGESTS)
    rest = map_batches(_in_order(pieces), finish, "k1 long, k2 long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    ids = _keyed(docs, text, F.col(f"`{doc_id}`").alias("doc_id")).drop("body")
    return ids.join(finished.unionByName(rest), ["k1", "k2"]).select("doc_id", *_DIGESTS)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int) of every row's text."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pieces = _encoded_texts(docs, shipped, text, whole=True)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(shipped.value)
        for batch in batches:
            runs = [np.frombuffer(b"".join(x.as_py() for x in row.values), kind).astype(np.int32) for row in batch.column("runs")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(runs, pa.list_(pa.int32()))], names=["k1", "k2", "ids"])

    finished = pieces.filter("seq = -1").select("k1", "k2", F.array("ids").alias("runs"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "ids")))  # one text's runs
    rest = _in_order(pieces).groupBy("k1", "k2").agg(ordered.getField("ids").alias("runs"))
    lists = map_batches(finished.unionByName(rest), unpack, "k1 long, k2 long, ids array<int>")
    ids = _keyed(docs, text, F.col(f"`{doc_id}`").alias("doc_id")).drop("body")
    return ids.join(lists, ["k1", "k2"]).select("doc_id", "ids")


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the text that each row's ids decode to; null ids give the empty text."""
    given = encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("given"))
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = spellings(shipped.value)[1]
        for batch in batches:
            texts = [b" ".join(map(tokens.__getitem__, x or [])).decode() for x in batch.column("given").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    schema = T.StructType([given.schema["doc_id"], T.StructField("text", T.StringType())])
    return map_batches(given, run, schema)
