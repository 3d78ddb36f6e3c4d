import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from dawnchorus.llm.recursive_bpe import (LONG, UNIT, Codec, decode_documents, encode_documents, read_ranks,
                                          round_trip_digests)
from tests.llm.helpers import SF, docs, with_clashes

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", None, "a" * 5000, "aaaa bbb  ccc\n\n\tx", "don't WE'LL I'm 's", "\u65e5\u672c\u8a9e \u6771\u4eac", "\x1c\x1d x\x85y\xa0z",
       "\U0001f600\U0001f600 \U0001f44d\U0001f3fd", "x\u200by \u3000wide", "12345 67.89 \u00bd\u00b2", "  lead", "trail  ", "\r\n\r\n",
       "\u00e1\u0301\u00c0" * 300, "<|endoftext|>", "!!!???" * 400, " " * 1000, "ab" * 3000, "\x00\x01", "'S 'T 'll x'll's", "   k"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_odd_texts_and_whole_table(spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(2, ODD[2])]
    encoded = encode_documents(with_clashes(docs(spark, rows)), PATH, PATTERN)
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == reference.encode_ordinary(ODD[r.doc_id] or "") and r.round_trip
    for r in decode_documents(encoded, PATH, PATTERN).collect():
        assert bytes(r.bytes) == (ODD[r.doc_id] or "").encode()
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in whole.collect()}
    for r in round_trip_digests(whole, PATH, PATTERN).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_recursive_query_and_heap_agree(reference):
    codec, rng = Codec(read_ranks(PATH), PATTERN), random.Random(5)
    words = [bytes(rng.choice(b"abcdetionsh\xc3\xa9") for _ in range(rng.randint(1, LONG))) for _ in range(300)]
    by_query = codec.encode_words(words)
    assert [codec.ranks.get(w) and [codec.ranks[w]] or codec._merge_long(w) for w in words] == by_query
    assert codec.decode_words(by_query) == words


def test_units_cut_where_the_pattern_does(reference):
    import regex
    rng, cut = random.Random(2), regex.compile(PATTERN).findall
    for _ in range(500):
        text = "".join(rng.choice(" \n\t\xa0ab'sl1.\u00e9\u3000") for _ in range(rng.randint(0, 30)))
        assert [p for u in UNIT.findall(text) for p in cut(u)] == cut(text)


def test_empty_table(spark):
    assert round_trip_digests(docs(spark, []), PATH, PATTERN).collect() == []
