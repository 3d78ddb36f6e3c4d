import random
import re
from collections import Counter

from dawnchorus.llm.line_frequency import Limits, apply_quality_rules
from tests.llm.helpers import docs, with_clashes


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "ccc", "é", "#x", "<b>", "|", "\U0001f600"])
    texts = [None, "", " \n\t\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 50, "x\x0by\x0cz\r\nw\r\nw",
             "l1\nl1\nl2\n l1\nl1", "q\u00a0r s", "\x1cfile sep"]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "\na\na"]) for _ in range(40)]
    texts.append(" ".join(f"w{rng.randint(0, 30000)}" for _ in range(60000)) + " " + "k1 k2 k3 k4 k5 k6 k7 k8 " * 2)
    rows = [*enumerate(texts), (4, texts[4])]
    got = apply_quality_rules(with_clashes(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, repeat = want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(n))


def test_frequent_lines_are_removed_per_host(spark):
    rng = random.Random(1)
    banner = "Click 123 here " + " ".join(f"b{i}" for i in range(40))
    rows = [(i, banner.replace("123", str(i)) + "\n" + _text(rng, 5), "hot") for i in range(60)]  # depleted
    rows += [(100 + i, banner + "\n" + _text(rng, 80), "hot") for i in range(30)]  # keep enough of their own
    rows += [(200 + i, _text(rng, 50), "hot") for i in range(200)]
    rows += [(500 + i, banner + "\n" + _text(rng, 5), "other") for i in range(5)]  # below the limit on this host
    copy = _text(rng, 60) + "\n" + _text(rng, 30)
    rows += [(600 + i, copy, "hot") for i in range(100)]  # copies count once
    rows += [(None, _text(rng, 30), None), (1000, _text(rng, 30), None)]
    got = apply_quality_rules(docs(spark, rows)).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(60))
    assert all(kept[i] for i in [*range(100, 130), *range(200, 400), *range(500, 505), *range(600, 700), None, 1000])
    assert all(r.removed_chars > 0 for r in got if r.doc_id is not None and 100 <= r.doc_id < 130)
    loose = apply_quality_rules(docs(spark, rows), Limits(max_documents=1000))
    assert loose.filter("kept").count() == len(rows)


def test_documents_of_several_shared_lines(spark):
    rng = random.Random(7)
    shared = [_text(rng, 3) for _ in range(20)]
    rows = [(i, "\n".join([*shared, _text(rng, 2)]), "hot") for i in range(200)]  # depleted
    rows += [(500 + i, "\n".join([*shared, _text(rng, 200)]), "hot") for i in range(20)]  # keep enough of their own
    rows += [(1000 + i, _text(rng, 30), "hot") for i in range(300)]
    copy = "\n".join(_text(rng, 20) for _ in range(3))
    rows += [(2000 + i, copy, "hot") for i in range(100)]  # copies count once
    got = apply_quality_rules(docs(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(200))
    # every shared line stands in 220 documents, so all 20 of them go
    chars = sum(len(x.replace(" ", "")) for x in shared)
    assert all(r.removed_chars == (chars if r.doc_id < 1000 else 0) for r in got)


def test_empty_table(spark):
    assert apply_quality_rules(docs(spark, [])).collect() == []
