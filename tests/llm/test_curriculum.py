"""The curriculum against brute force: targets, words taken, positions and the mix at each moment."""

from collections import Counter, defaultdict

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from granary.llm import curriculum, queries


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_sql(spark, size):
    sf = f"/root/testdata/{size}"
    got, want = compare(spark, sf, connect(sf), queries.op11_mixing, queries.OP11_SQL)
    assert got == want


def shared(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    target, open_, left = dict.fromkeys(sizes, 0.0), {s for s in sizes if weights[s] > 0}, share * sum(n for s, n in sizes.items() if weights[s] > 0)
    while left > 1e-9 and open_:
        total, more = sum(weights[s] for s in open_), left
        left = 0.0
        for s in sorted(open_):
            target[s] += more * weights[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def made(spark, rows, **more):
    return curriculum.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), **more)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 1000, "b": 10, "c": 10}, {"a": 7, "b": 7, "c": 7, "d": 7, "e": 0}, {"a": 5}])
def test_targets(spark, sizes):
    rows = [(k, s, n) for k, (s, n) in enumerate(sizes.items())]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = shared(sizes, weights, 1.5, 2)
    for r in made(spark, rows).collect():
        assert r["target"] == pytest.approx(want[r["source"]]) and abs(r["taken"] - r["target"]) <= 0.5 and r["taken"] <= 2 * r["size"]


def test_mix_at_each_moment(spark):
    rows = [(k, s, 1 + k % 5) for k in range(6000) for s in ("a", "b", "c") if k % 3 == "abc".index(s)]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    visits = curriculum.visits(made(spark, rows, share=0.9)).collect()
    assert [v["position"] for v in visits] == sorted(v["position"] for v in visits)
    at = {"a": lambda u: 4 * u if u <= 0.5 else 2 + 4 * (u - 0.5) - 4 * (u - 0.5) ** 2, "b": lambda u: u * u, "c": lambda u: 2 * u}
    for u in (0.1, 0.3, 0.5, 0.77, 0.9):
        for s, integral in at.items():
            held = sum(v["size"] for v in visits if v["source"] == s and v["position"] <= u)
            target = next(v["target"] for v in visits if v["source"] == s)
            assert held == pytest.approx(target * integral(u) / integral(1), abs=10)


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", None), (None, None, 3), (2, "", 0), (3, "é", 10_000_000), (4, "z", -3), (5, "z", 1), (5, "z", 1)]
    docs = spark.createDataFrame([(*r, "kept", 1.0, "x") for r in rows], "doc_id long, source string, size long, granary_key string, target double, `a b` string")
    out = curriculum.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["granary_key"], r["a b"]) for r in out) == Counter((*r, "kept", "x") for r in rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * max(r["size"] or 0, 0) and (r["position"] is None) == (r["taken"] == 0) and len(r["positions"]) == -(-r["taken"] // max(r["size"] or 1, 1))
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert curriculum.mix(docs.limit(0)).count() == 0


def test_same_for_any_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", curriculum.words().alias("size"))
    rows = lambda d: sorted(map(str, curriculum.mix(d).collect()))
    assert rows(docs) == rows(docs.repartition(7, "size"))


def test_sources_of_no_weight(spark):
    weights = F.when(F.col("source") == "a", curriculum.schedule((0, 0), (1, 0))).otherwise(curriculum.schedule((0, -1), (0.5, 0), (0.75, 2), (1, 0)))
    got = defaultdict(int)
    rows = made(spark, [(k, "ab"[k % 2], 10) for k in range(40)], schedules=weights, share=1.0).collect()
    for r in rows:
        got[r["source"]] += r["taken"]
        assert r["position"] is None or r["position"] > 0.5
    assert got == {"a": 0, "b": 200}


def test_bad_schedule():
    with pytest.raises(ValueError):
        curriculum.schedule((0, 1), (0.5, 1))


def test_plan_has_no_python(spark, sf):
    plan = queries.op11_mixing(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
