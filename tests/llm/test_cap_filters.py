import numpy as np

from dawnchorus.llm import cap_filters
from dawnchorus.llm.cap_filters import ProductCode, near_duplicates
from dawnchorus.llm.queries import QUERIES
from tests.llm.helpers import SF


def brute(rows, cosine=0.95):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    x = [np.array(v, float) / np.abs(v).max() for _, v in rows]
    x = [v / np.linalg.norm(v) for v in x]
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = {i: 0 for i, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if len(x[a]) == len(x[b]) and x[a] @ x[b] >= cosine:
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def _rows():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size, noise in [(1, 0)] * 150 + [(2, 0.02), (5, 0.03), (40, 0.02), (90, 0.035), (30, 0.04)]:
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        for _ in range(size):
            rows.append((n, [float(v) for v in np.float32(base + noise * rng.standard_normal(64))]))
            n += 1
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = _rows()
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [2 * v for v in rows[0][1]]), (903, None), (904, [0.0] * 64),
             (905, [float("nan")] * 64), (906, [1.0, None]), (907, []), (908, [1.0, 0.0]), (909, [1.0, 0.001]), (910, [float("inf")] * 3),
             (911, [3.0]), (912, [5.0]), (913, [-5.0]), (914, [1e-300, 0.0]), (None, rows[0][1]), (900, rows[0][1])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    want = brute(rows)
    for block in (2048, 16):  # small blocks: a bucket is cut into many pairs of blocks
        monkeypatch.setattr(cap_filters, "BLOCK", block)
        got = near_duplicates(table).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, None)
            else:
                assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)), r
                assert r.kept == (r.vec_id == r.component_id)


def test_recall_at_the_limit():
    """Pairs exactly at the limit share a filter, whatever the number of filters."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for size in (64, 1000, 8000):
        met = np.zeros(len(x), bool)
        for seed in range(cap_filters.CODES):
            code = ProductCode(64, size, seed)
            met |= [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y), strict=True)]
        assert met.mean() > 0.995


def test_whole_table_and_empty(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op9_cap_filters"](spark, SF).collect()} == want
    assert near_duplicates(table.limit(0)).collect() == []
