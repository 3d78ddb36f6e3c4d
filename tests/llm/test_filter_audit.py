import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import types as T

from dawnchorus.llm.filter_audit import FILTERS, REPEATED, audit_filters, orders_of, removal_steps
from tests.llm.helpers import docs, with_clashes

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")])


def _fails(rows):
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
        out.append({f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search("[#$%&*|]", text), smaller), strict=True) if bad})
    return out


def brute(rows, labels):
    """Every order applied to every document, one filter after the other."""
    fails = _fails(rows)
    out = {}
    parts = [r[2] or "" for r in rows]
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    for part in set(parts):
        mine = [i for i, p in enumerate(parts) if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in fails[i] for i in mine) - len(gone), sum(fails[i] == {f} for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(share[f])
    return out


def _rows(rng):
    texts = ["", None, "a # b", "one " * 300, "W " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(199)),
             "É" * 50, "A" + "b" * 49, "A" + "b" * 48, "x|y", " ".join(f"T{i}" for i in range(230)), "p" * 5000]
    return [(rng.randint(0, 60) if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(120)]


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = _rows(rng)
    labels = [(rng.randint(0, 70), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)]
    got = audit_filters(with_clashes(docs(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r[c] for c in COUNTS] == want[r.part, r.filter_order, r.step], (r, want[r.part, r.filter_order, r.step])


def test_min_plus_ranks():
    orders = orders_of("ABC")
    steps = removal_steps("ABC", orders)
    assert steps.shape == (6, 8) and len(set(orders)) == 6
    for i, order in enumerate(orders):
        for mask in range(8):
            failed = [order.index(f) + 1 for k, f in enumerate("ABC") if mask >> k & 1]
            assert steps[i, mask] == min(failed, default=4)


def test_own_filters_and_empty_table(spark):
    none = spark.createDataFrame([], LABELS)
    own = {"x": lambda body, words: not words, "y": REPEATED}
    got = audit_filters(docs(spark, [(1, ""), (2, ""), (3, "a")]), none, filters=own)
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got.collect()}
    assert rows == {("xy", 1): (1, 2, 0, 3), ("xy", 2): (1, 0, 1, 1), ("yx", 1): (2, 1, 0, 1), ("yx", 2): (1, 1, 1, 3)}
    assert audit_filters(docs(spark, []), none).collect() == []
    assert np.prod(removal_steps("".join(FILTERS), orders_of("".join(FILTERS))).shape) == 120 * 32
