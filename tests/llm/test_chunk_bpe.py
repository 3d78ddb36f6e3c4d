import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dawnchorus.llm import chunk_bpe
from dawnchorus.llm.chunk_bpe import Words, chunk_ends, decode_documents, encode_documents, encode_text, round_trip_digests
from dawnchorus.llm.common import read_table
from dawnchorus.llm.queries import word_vocabulary
from tests.llm.helpers import SF, docs, with_clashes

VOCABULARY = word_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _passage(rng, n):
    return " ".join("".join(rng.choice("abcdeoé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def _odd(rng):
    shared = _passage(rng, 900)
    return ["", None, " ", "a" * 9000, "don't WE'LL I'm", "x<|endoftext|>y <|startoftext|>", "é" * 900 + " İx",
            "日本語" * 2000, "1234" * 3000 + " 5", "\u0085a b　c" * 300, "\x00\x1c \x1d", "!?" * 4000 + "'s 's",
            shared, shared.upper(), "lead " + shared, shared + " trail", shared + "<|endoftext|>" + shared, shared[:4000] + "\n" + shared,
            "\U0001f600\U0001f44d\U0001f3fd" * 500, "Å̧ " * 800, shared]


def _want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_texts_against_the_library(spark, library):
    texts = _odd(random.Random(3))
    frame = with_clashes(docs(spark, [*enumerate(texts), (4, texts[4]), (None, "null id")]))
    rows = round_trip_digests(frame, VOCABULARY).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _want(library, text), text and text[:40]
    encoded = encode_documents(frame, VOCABULARY)
    for r in encoded.collect():
        text = "null id" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == library.encode(text or "", add_special_tokens=False).ids
    for r in decode_documents(encoded, VOCABULARY).collect():
        text = "null id" if r.doc_id is None else texts[r.doc_id]
        assert r.text == library.decode(library.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_whole_table_against_the_library(spark, library):
    table = read_table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in table.collect()}
    rows = round_trip_digests(table, VOCABULARY).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _want(library, texts[r.doc_id])


def test_shared_chunks_are_encoded_once_and_joins_repaired(library):
    """Two texts share a passage at different places: the second takes its chunks from the first."""
    rng = random.Random(8)
    passage = _passage(rng, 3000)
    first, second = (_passage(rng, 500) + passage).encode(), (_passage(rng, 777) + passage + _passage(rng, 60)).encode()
    words = Words(VOCABULARY)
    from dawnchorus.llm.chunk_bpe import _key, insides
    both = {_key(first[a:b]) for a, b in insides(first)} & {_key(second[a:b]) for a, b in insides(second)}
    assert len(both) >= 8
    own = {key: ids for kind, key, ids in encode_text(words, first, dict.fromkeys(both, True)) if kind == "own"}
    assert own.keys() == both
    parts = list(encode_text(words, second, dict.fromkeys(both, False)))
    taken = [key for kind, key, _ in parts if kind == "of"]
    assert set(taken) == both
    ids = b"".join(own[a] if kind == "of" else a for kind, a, _ in parts)
    assert ids == words.window(second)


def test_cuts_depend_on_what_is_near_and_keep_characters(library):
    rng = random.Random(5)
    passage = _passage(rng, 40000)
    ends = chunk_ends(passage.encode(), 300)
    assert len(passage) / 900 < len(ends) < len(passage) / 100
    moved = chunk_ends(("x" * 70001 + passage).encode(), 300)
    assert set(e + 70001 for e in ends[1:]) <= set(moved)
    for text in ["", "é" * 40000, "\U0001f600a" * 9000]:
        start, body = 0, text.encode()
        for end in chunk_ends(body, 8):
            body[start:end].decode()
            start = end
        assert start == len(body)


def test_empty_table(spark):
    assert round_trip_digests(docs(spark, []), VOCABULARY).collect() == []
    assert encode_documents(docs(spark, []), VOCABULARY).collect() == []


def test_many_texts_share_one_chunk(spark, library):
    """A passage that a third of all texts hold is a reference in each of them."""
    rng = random.Random(2)
    passage = _passage(rng, 1500)
    rows = [(i, f"{_passage(rng, rng.randint(0, 300))} {passage if i % 3 == 0 else ''}") for i in range(300)]
    texts = dict(rows)
    for r in round_trip_digests(docs(spark, rows).repartition(7, F.col("doc_id")), VOCABULARY).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _want(library, texts[r.doc_id])


def test_words_stay_known_from_task_to_task(monkeypatch):
    """A worker's second task asks only for words that it has not met, and finds the same ids."""
    vocabulary = open(public_tokenizers.path("word_bpe_49k.json")).read()
    first = chunk_bpe.worker_words(vocabulary)
    ids = first.encode([b"some", b"quite", b"Common,", b"words"])

    class Counting:
        asked = []

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            self.asked += texts
            return self.tokenizer.encode_batch_fast(texts, **options)

    second = chunk_bpe.worker_words(vocabulary)
    monkeypatch.setattr(second, "tokenizer", Counting(second.tokenizer))
    assert second.encode([b"some", b"quite", b"Common,", b"words"]) == ids == chunk_bpe.Words(vocabulary).encode([b"some", b"quite", b"Common,", b"words"])
    assert Counting.asked == []
    second.encode([b"words", b"unheardofhere"])
    assert Counting.asked == ["unheardofhere"]
