import math

from dawnchorus.llm.poisson_mixing import mix_sources, poisson_tables, source_rates
from tests.llm.helpers import docs, with_clashes


def test_tables_are_the_poisson_distribution(spark):
    rates = spark.createDataFrame([("a", 0.01), ("b", 1.5), ("c", 40.0), ("d", 5000.0)], "mix_source string, rate double")
    for r in poisson_tables(rates).join(rates, "mix_source").collect():
        total, at = 0.0, {}
        for k in range(int(r.rate + 13 * math.sqrt(r.rate) + 14)):
            total += math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1))
            at[k] = total
        for i, c in enumerate(r.cumulative):
            assert abs(c - at[r.first_k + i]) < 1e-9
        assert abs(r.cumulative[-1] - 1) < 1e-9


def test_shares_counts_and_content(spark):
    rows = [(i, f"t{i}", "big" if i < 3000 else "mid" if i < 3900 else "tiny" if i < 3990 else None) for i in range(4000)]
    given = with_clashes(docs(spark, rows))
    mixed = mix_sources(given, alpha=0.0, total=8000)
    assert mixed.columns == [c for c in given.columns if c != "mix_copy"] + ["mix_copy"]
    got = mixed.collect()
    per = {}
    for r in got:
        per[r.source] = per.get(r.source, 0) + 1
        assert r.text == f"t{r.doc_id}"
    assert all(abs(per[s] - 2000) < 250 for s in ("big", "mid"))
    assert abs(per["tiny"] - 2000) < 700 and abs(per[None] - 2000) < 1200
    again = mix_sources(given, alpha=0.0, total=8000).collect()
    assert sorted((r.doc_id, r.mix_copy) for r in got) == sorted((r.doc_id, r.mix_copy) for r in again)
    place = {r.doc_id: i for i, r in enumerate(got)}
    ids = [d for d in place if d < 3000]
    assert abs(sum(place[d] for d in ids) / len(ids) - len(got) / 2) < 0.1 * len(got)  # shuffled


def test_weights_nulls_and_repeats(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, "x"), (2, "b", "y"), (3, "c", "z")]
    weights = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "source string, weight double")
    got = mix_sources(docs(spark, rows), weights, total=300).collect()
    assert {r.source for r in got} == {"x"}
    twice = sorted(r.mix_copy for r in got if r.doc_id == 1)
    assert twice == sorted([*range(len(twice) // 2)] * 2)
    assert mix_sources(docs(spark, [])).collect() == []
    assert source_rates(docs(spark, rows), weights, total=300).count() == 1
