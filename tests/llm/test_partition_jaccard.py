import random

import numpy as np
import pytest

from dawnchorus.llm import partition_jaccard
from dawnchorus.llm.components import connected_components
from dawnchorus.llm.partition_jaccard import (Band, band_tops, bands_of, jaccard_components, keep_one_of_each,
                                              shingle_hashes, signatures)
from tests.llm.helpers import SF, docs, jaccard_components as brute, shingle_set, with_clashes


def _weights(one, other, deletions):
    """For the band of the smaller set: {segment: weight} of the first set's agreements, and the weight to spare."""
    own = bands_of(min(len(one), len(other)))[0].number
    band = next(b for b in bands_of(len(one)) if b.number == own)
    keys, tags = signatures(one, band, False, deletions)
    met = np.isin(keys, signatures(other, next(b for b in bands_of(len(other)) if b.number == own), False, deletions)[0])
    weights = {}
    for tag in tags[met]:
        weights[tag >> 26] = max(weights.get(tag >> 26, 0), 1 if not deletions or tag & 1 else 2)
    return weights, band.spare_weight if deletions else band.spare


def test_pigeonhole_holds_for_every_size_and_worst_partner():
    """A pair at the limit agrees on more segments, and weight, than may be passed over, as either set counts it."""
    rng = np.random.default_rng(0)
    for size in [*range(1, 60), 75, 100, 101, 180, 400, 1500, 6000]:
        for trial in range(6):
            big = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            if trial % 2:  # the smaller is a subset
                small = np.sort(rng.permutation(big)[:max(1, -(-4 * size // 5))])
            else:  # replace elements
                change = size // 9
                if 100 * (size - change) < 80 * (size + change):
                    continue
                kept = rng.permutation(big)[:size - change]
                small = np.unique(np.concatenate([kept, rng.integers(0, 2**63, change, dtype=np.uint64)]))
            both = len(np.intersect1d(big, small))
            if 100 * both < 80 * (len(big) + len(small) - both):
                continue
            for one, other in ((big, small), (small, big)):
                for deletions in (False, True):
                    weights, spare = _weights(one, other, deletions)
                    assert sum(weights.values()) > spare, size


def test_bands():
    tops = band_tops(10**6)
    assert all(a < b for a, b in zip(tops, tops[1:], strict=False))
    for most in tops:
        band = Band(0, most)
        assert band.segments - band.spare == band.differ + 1 and band.spare >= 0
        assert 2 * band.segments - band.spare_weight == band.differ + 1
    for size in range(1, 3000):
        smallest = -(-4 * size // 5)
        numbers = {b.number for b in bands_of(size)}
        assert {bands_of(r)[0].number for r in range(smallest, size + 1)} <= numbers


def _family(rng, n_words, copies, edits, start):
    base = [f"w{rng.randint(0, 50000)}" for _ in range(n_words)]
    out = []
    for i in range(copies):
        words = base[:]
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**9)}"
        out.append((start + i, " ".join(words)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows, at = [], 1000
    for n_words, copies, edits in [(5, 4, 0), (6, 5, 1), (9, 6, 1), (14, 6, 1), (25, 8, 1), (60, 8, 1), (120, 10, 2), (400, 10, 6),
                                   (1000, 6, 12), (3000, 4, 50), (60, 30, 3), (300, 60, 4)]:
        family = _family(rng, n_words, copies, edits, at)
        at += copies
        rows += [(i, t[:rng.randint(int(0.8 * len(t)), len(t))] if rng.random() < 0.3 else t) for i, t in family]
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(at + i, passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 60)))) for i in range(60)]
    rows += [(1, ""), (2, None), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "a b c"), (7, "x y z w v"), (8, "X Y Z W V"), (9, "É b"), (10, "é b")]
    rows += [(11, "the " * 3000), (12, "the " * 4000), (13, rows[0][1]), (14, rows[0][1].upper())]
    got = jaccard_components(with_clashes(docs(spark, [*rows, rows[3], (None, rows[0][1])]))).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def _crowd(rng, n):
    """Texts of ten sections, of which all but two are the same in all, and the two are shared with a few others."""
    section = lambda name: " ".join(f"{name}-{i}" for i in range(12))
    out = []
    for i in range(n):
        own = rng.sample(range(10), 2)
        out.append((i, " ".join(section(f"s{k}v{rng.randrange(n // 40)}" if k in own else f"s{k}") for k in range(10))))
    return out


def test_a_crowd_below_the_limit_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Documents that share much with very many, and with few as much as a link needs, make few candidates."""
    rows = _crowd(random.Random(11), 240)
    tried, links = [], partition_jaccard.verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(partition_jaccard, "verified", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows)).collect()}
    assert got == brute(rows)
    assert sum(tried) < 10 * len(rows), tried


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 300, 400)]
    texts = ["", "a", " ".join(words), " ".join(words[:350]), " ".join([*words[:200], "x", *words[201:]]), " ".join(words * 20)]
    found = [partition_jaccard.parities(shingle_hashes(t)) for t in texts]
    for a, p in zip(texts, found, strict=True):
        for b, q in zip(texts, found, strict=True):
            differ = sum(int(x).bit_count() for x in (p ^ q).view(np.uint64))
            assert differ <= len(shingle_set(a) ^ shingle_set(b)) and (a != b or differ == 0)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in table.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table).collect()} == want


def test_keep_one_of_each(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words"), (9, "other words"), (None, "x"), (None, "x"), (7, "")]
    got = keep_one_of_each(with_clashes(docs(spark, rows)))
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == \
        [(False, 3), (False, 7), (False, 9), (True, None), (True, None)]
    assert keep_one_of_each(docs(spark, [])).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    """Each row by its own text: none is lost, and sizes are those of the text."""
    a, b = "a b c d e f", "u v w x y z q r"
    rows = [(1, a), (1, b), (2, a), (7, b), (1, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (1, 4, 1), (2, 2, 1), (7, 4, 1)]
    kept = sorted((r.doc_id, r.text) for r in keep_one_of_each(docs(spark, rows)).collect())
    assert kept == [(1, a), (1, b)]
    rows = [(1, a), (1, b), (2, a)]
    assert sorted((r.doc_id, r.text) for r in keep_one_of_each(docs(spark, rows)).collect()) == [(1, a), (1, b)]


def test_hashes_count_shingles():
    for text in ["", "a", "a b c d", "a b c d e", "a b c d e a b c d e a b c d e", "x " * 100]:
        assert len(shingle_hashes(text)) == len(shingle_set(text))


@pytest.mark.parametrize("edges,want", [
    ([], {}), ([(1, 1), (None, 2)], {}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(1, 41)}),
    ([(7, i) for i in range(8, 60)] + [(59, 3), (100, 101), (101, 100)], {**{i: 3 for i in range(7, 60)}, 101: 100})])
def test_components(spark, edges, want):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want
