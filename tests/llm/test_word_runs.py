import hashlib
import random
import re
import zlib

from dawnchorus.llm.common import read_table
from dawnchorus.llm.queries import op12_word_runs
from dawnchorus.llm.word_runs import boundary_runs, find_runs, repair, run_digests, word_runs, zones
from tests.llm.helpers import SF, docs, with_clashes


def brute(words):
    """For every period the maximal stretches, then only the smallest period of a stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _random_words(rng):
    n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 30])
    words = [str(rng.randrange(kinds)) for _ in range(n)]
    if rng.random() < 0.6 and n > 5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    if rng.random() < 0.3 and n > 30:
        part, i = words[:rng.randint(3, 15)], rng.randrange(n)
        words = words[:i] + part * rng.randint(2, 4) + words[i:]
    return words


def test_random_words_against_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        words = _random_words(rng)
        assert word_runs(words) == brute(words), words


def test_known_sequences():
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    thue = ["ab"[bin(i).count("1") % 2] for i in range(1500)]
    for words in [list(fib[-1]), thue, ["x"] * 1000, list(map(str, range(400))) * 2, list(map(str, range(400))) + ["y"] * 11]:
        assert word_runs(words) == brute(words)
    assert word_runs(["x"] * 12) == [(0, 12, 1)] and word_runs(["x"] * 11) == []
    assert word_runs(list("abcdef") * 2) == [(0, 12, 6)] and word_runs(list("abcdefg") * 2)[0][1] == 14


def test_grammar_derives_the_words_and_no_pair_stands_twice():
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(rng.choice([2, 5])) for _ in range(rng.randint(0, 200))]
        rest, rules = repair(ids)

        def derive(x, rules=rules):
            return [x] if x not in rules else derive(rules[x][0]) + derive(rules[x][1])

        assert [w for x in rest for w in derive(x)] == ids
        pairs, last = set(), None
        for p in zip(rest, rest[1:], strict=False):
            assert p not in pairs or p == last  # only an overlapping one may come again
            pairs.add(p)
            last = p


def test_runs_across_one_boundary():
    rng = random.Random(4)
    for _ in range(300):
        y, z = ([rng.randrange(2) for _ in range(rng.randint(1, 25))] for _ in range(2))
        crossing = {r for r in brute(y + z) if r[0] < len(y) < r[0] + r[1]}
        assert crossing <= set(boundary_runs(y, z))


def test_zones_hold_every_run():
    rng = random.Random(9)
    for _ in range(300):
        words = _random_words(rng)
        spans = zones(words)
        assert all(any(a <= s and s + n <= b for a, b in spans) for s, n, _ in brute(words))


def _digest_row(words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    rows = op12_word_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        words = _planted(r.doc_id, texts[r.doc_id])
        if len(words) < 3000:
            assert tuple(r[f] for f in FIELDS) == _digest_row(words)


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "x " * 5000, "a b " * 6 + " ", "a\u0085b " * 20, "é " * 12 + "end", "x " * 11]
    rows = [*enumerate(texts), (3, texts[3]), (None, "y " * 20)]
    got = run_digests(with_clashes(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", ("y " * 20 if r.doc_id is None else texts[r.doc_id]) or "")
        assert tuple(r[f] for f in FIELDS) == _digest_row(words)
    spans = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs(spark, rows)).collect()}
    assert spans[3] == ([(0, 5000, 1)], "x") and spans[0] == ([], "") and spans[7] == ([], " ".join(["x"] * 11))
    assert run_digests(docs(spark, [])).collect() == [] and find_runs(docs(spark, [])).collect() == []


def test_long_texts_in_little_time():
    import time
    start = time.time()
    assert len(word_runs([str(i % 777) for i in range(60000)])) == 1
    assert word_runs([str(i) for i in range(60000)]) == []
    assert len(word_runs(["x"] * 60000)) == 1
    assert time.time() - start < 60
