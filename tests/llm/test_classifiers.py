import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dawnchorus.llm import importance_resampling as quality
from dawnchorus.llm import ordinal_toxicity as toxicity
from dawnchorus.llm.common import SLICE_ROWS, map_batches, materialize, score_rows
from dawnchorus.llm.queries import good_labels, toxic_labels
from tests.llm.helpers import docs, scratch, with_clashes

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet")


def _split(labels):
    """Half of the labelled rows to train on; the rest as a dict."""
    from pyspark.sql import functions as F
    half = F.xxhash64("doc_id") % 2 == 0
    return labels.filter(half), {r[0]: r[1] for r in labels.filter(~half).collect()}


def test_quality_on_held_out_labels(spark, table):
    train, held = _split(good_labels(spark, LARGER))
    got = {r.doc_id: r.kept for r in quality.resample(with_clashes(table), train).select("row.doc_id", "kept").collect()}
    assert len(got) == table.count()
    good, bad = [i for i in held if held[i]], [i for i in held if not held[i]]
    assert np.mean([got[i] for i in good]) > 0.95
    assert np.mean([got[i] for i in bad]) < 0.35


def test_raw_model_counts_all_documents(spark, table):
    """The model equals the one from counts made in one place."""
    labels = good_labels(spark, LARGER)
    roles = quality.labelled_roles(labels)
    target = {r.doc_id for r in roles.filter("role = 1").collect()}
    raw, aim = np.zeros(quality.BUCKETS + 2), np.zeros(quality.BUCKETS + 2)
    for r in table.collect():
        n = np.bincount(quality.buckets(r.text), minlength=quality.BUCKETS + 2)
        raw += n
        aim += n * (r.doc_id in target)
    p = (raw + 0.5) / (raw + 0.5).sum()
    assert np.allclose(quality.fit(table, roles), np.log((aim + len(raw) * p) / (aim.sum() + len(raw)) / p))


def test_gumbel_top_k_draws_k_and_in_proportion(spark):
    rows = [(i, "a") for i in range(2000)]
    labels = spark.createDataFrame([], "doc_id long, good boolean")
    got = quality.resample(docs(spark, rows), labels, k=500)
    assert got.filter("kept").count() == 500
    assert quality.resample(docs(spark, rows), labels).filter("kept").count() == 2000  # no labels: all
    assert quality.resample(docs(spark, rows), labels, k=0).filter("kept").count() == 0
    assert quality.resample(docs(spark, rows), labels, k=5000).filter("kept").count() == 2000


def test_weights_keys_and_choice_equal_brute_force(spark):
    """Labelled ids repeat with other texts; k follows from the cut."""
    rng = random.Random(3)
    good, bad = "the sea lies calm under a pale morning sky".split(), "BUY now !! cheap $$ CLICK here win".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(3, 30)))) for i in range(120)]
    rows += [(7, "calm sea " * n) for n in range(1, 40)] + [(8, "BUY CLICK win " * n) for n in range(1, 40)]
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(90)], "doc_id long, good boolean")
    roles = {r.doc_id: r.role for r in quality.labelled_roles(labels).collect()}
    ratio = quality.fit(docs(spark, rows), spark.createDataFrame(list(roles.items()), "doc_id long, role int"))
    weight = [float(ratio[quality.buckets(t)].sum()) for _, t in rows]

    def key(i, w):
        u = (int(hashlib.md5(f"resample|{i}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
        return w - math.log(-math.log(u))

    keys = [key(i, w) for (i, _), w in zip(rows, weight, strict=True)]
    least = {}
    for (i, _), w in zip(rows, weight, strict=True):
        if roles.get(i, 1) > 1:
            least[i] = min(w, least.get(i, w))
    kind = {r: sorted(w for i, w in least.items() if roles[i] == r) for r in (2, 3)}
    at = sorted(set(least.values()))
    cuts = [-math.inf, *[(a + b) / 2 for a, b in zip(at, at[1:], strict=False)], math.inf]
    gain = [sum(w < c for w in kind[3]) / len(kind[3]) - 2 * sum(w < c for w in kind[2]) / len(kind[2]) for c in cuts]
    cut = cuts[gain.index(max(gain))]
    k = sum(w >= cut for w in weight)
    assert 0 < k < len(rows)
    last = sorted(keys, reverse=True)[k - 1]
    expected = sorted((rows[n][0], rows[n][1], round(weight[n], 6), round(keys[n], 6), keys[n] >= last) for n in range(len(rows)))
    got = quality.resample(docs(spark, rows), labels).collect()
    found = sorted((r.row.doc_id, r.row.text, round(r.log_weight, 6), round(r.key, 6), r.kept) for r in got)
    assert [f[:2] + f[4:] for f in found] == [e[:2] + e[4:] for e in expected]
    assert np.allclose([f[2:4] for f in found], [e[2:4] for e in expected], atol=1e-5)


@pytest.mark.parametrize("values", [[5, 3, 3, -7, 0, 2**62, -2**62, -1], [0], [-(1 << 63), (1 << 63) - 1, 1]])
def test_radix_selection(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 60000), (4, "Some words stand here."), (5, "A B !! C !!")]
    labels = spark.createDataFrame([(4, True), (5, False), (5, None), (None, True), (77, True)], "doc_id long, good boolean")
    given = with_clashes(docs(spark, rows))
    got = quality.resample(given, labels).collect()
    assert len(got) == len(rows) and all(r.log_weight == 0 for r in got if not r.row.text)
    assert quality.quality_filter(given, labels).columns == given.columns
    assert quality.quality_filter(docs(spark, []), labels).collect() == []


def test_quality_filter_leaves_no_copy_of_the_texts(spark):
    """It takes what ``resample`` draws; no scratch file that outlives the call holds the texts."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(200)]), " ".join(f"{rng.getrandbits(40):x}" for _ in range(rng.randint(0, 400)))) for _ in range(400)]
    rows += rows[:50] + [(3, None), (4, "")]
    given = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 3 > 0) for i in range(150)], "doc_id long, good boolean")
    for k in (None, 100, 0):
        before = scratch(spark)
        got = quality.quality_filter(given, labels, k=k).collect()
        left = sum(n for p, n in scratch(spark).items() if p not in before)
        assert left < 0.05 * sum(len(t or "") for _, t in rows)
        want = quality.resample(given, labels, k=k).filter("kept").collect()
        assert sorted(map(repr, got)) == sorted(repr(r.row) for r in want) and bool(got) == (k != 0)


def test_toxicity_on_held_out_labels(spark, table):
    train, held = _split(toxic_labels(spark, LARGER))
    got = {r.doc_id: r for r in toxicity.judge_toxicity(with_clashes(table), train)
           .select("row.doc_id", "toxic", "severity").collect()}
    assert len(got) == table.count()
    toxic, clean = [i for i in held if held[i]], [i for i in held if not held[i]]
    assert np.mean([got[i].toxic for i in clean]) < 0.03
    assert np.mean([got[i].toxic for i in toxic]) > 0.7
    assert np.mean([got[i].severity for i in toxic]) > 10 * np.mean([got[i].severity for i in clean])


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n, w = 4000, np.array([2.0, -1.0, 0.0])
    x = rng.standard_normal((n, 3))
    y = np.searchsorted([-1.0, 1.5], x @ w + rng.logistic(size=n))
    row, at = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    weights, cuts = toxicity.fit_ordinal(x.ravel(), at, row, y, 3, rounds=800)
    assert np.allclose(weights, w, atol=0.2) and np.allclose(cuts, [-1.0, 1.5], atol=0.2)


def test_severity_follows_grades(spark):
    rows = [(i, "calm words about the sea " * 4 + "bad " * (i % 3) * 3) for i in range(300)]
    grades = spark.createDataFrame([(i, i % 3) for i in range(300)], "doc_id long, grade int")
    model = toxicity.fit(docs(spark, rows), grades)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 2
    got = {r.doc_id: r for r in toxicity.score_severity(docs(spark, rows), model).select("row.doc_id", "severity", "toxic").collect()}
    assert got[0].severity < 0.3 < 0.7 < got[1].severity < 1.4 < 1.7 < got[2].severity
    assert all(r.toxic == (i % 3 > 0) for i, r in got.items())


def test_severity_equals_brute_force(spark):
    rng = random.Random(4)
    words = "calm sea bad badly badness awful1 AWFUL stone stones Stoney".split()
    rows = [(i, " ".join(rng.choice(words[:2] if i % 3 == 0 else words) for _ in range(rng.randint(1, 25)))) for i in range(200)]
    grades = spark.createDataFrame([(i, i % 3) for i in range(200)], "doc_id long, grade int")
    model = toxicity.fit(docs(spark, rows), grades)
    for r in toxicity.score_severity(docs(spark, rows), model).collect():
        met = re.findall(r"[^\W\d_]+", r.row.text.lower())
        score = 0.0
        for term, at in model.terms.items():
            n = sum(w == term or (term[-1] == "-" and len(w) >= len(term) and w.startswith(term[:-1])) for w in met)
            score += model.weights[at] * math.log1p(100 * n / max(len(met), 1))
        above = [1 / (1 + math.exp(c - score)) for c in model.cuts]
        assert math.isclose(r.severity, sum(above), abs_tol=1e-9) and r.toxic == (above[0] >= model.level)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "bad bad"), (3, "word " * 60000), (3, "bad"), (4, "fine")]
    given = with_clashes(docs(spark, rows))
    none = spark.createDataFrame([(4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity_filter(given, none).count() == len(rows)  # nothing learned, nothing flagged
    assert toxicity.toxicity_filter(given, none).columns == given.columns
    assert toxicity.toxicity_filter(docs(spark, []), none).collect() == []


def test_toxicity_filter_leaves_no_training_texts(spark):
    rows = [(i, "calm words about the sea " * 4 + "bad awful " * (i % 3)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, toxic int")
    before = scratch(spark)
    for some in (labels, labels.filter("toxic = 0")):
        kept = {r.doc_id for r in toxicity.toxicity_filter(docs(spark, rows), some).collect()}
        assert kept == {i for i in range(300) if i % 3 == 0 or some is not labels}
    assert not [p for p in scratch(spark) if p not in before and p[0].startswith("grade-rows")]


def test_texts_are_scored_some_at_a_time_and_go_once(spark):
    """A batch's texts are never all Python objects at once, a text of the packed row is not sent beside it, and
    what is written gets its Arrow batches by bytes."""
    docs = spark.range(0, 1300, 1, 1).selectExpr("id as doc_id", "if(id = 7, null, repeat('ab ', 10000)) as text")

    def make():
        return lambda texts: ([len(texts)] * len(texts), [len(t) for t in texts])

    for columns in (None, ["text"], ["doc_id"]):
        scored = score_rows(docs, "text", {"met": "long", "size": "long"}, make, columns)
        rows = scored.select("met", "size").collect()
        assert max(r.met for r in rows) <= SLICE_ROWS and sorted({r.size for r in rows}) == [0, 30000] and len(rows) == 1300
        plan = scored._jdf.queryExecution().analyzed().toString()
        assert ("AS body" in plan) == (columns == ["doc_id"])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert max(r.n for r in materialize(map_batches(docs, sizes, "n long"), "sizes").collect()) < 16 << 20
    assert spark.conf.get(key) == before
