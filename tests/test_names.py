"""Name matching, numbering and upserts against brute force on small made tables."""

import random
import re

import pytest

from granary.operators import ledger as L


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.mark.parametrize("often", [0, 3, 64])
def test_contained_names(spark, often):
    rng = random.Random(often)
    word = lambda: "".join(rng.choices("ab-_C（é", k=rng.randint(0, 9)))
    left = [word() for _ in range(150)] + ["", "a", "--", "Common front of all 1", "common_front of all"]
    right = [word() for _ in range(150)] + ["", "b", "__", "COMMON", *(f"common front of all {k}" for k in range(40))]
    norm = lambda x: re.sub(r"[\s\-_—（）()\[\]【】《》]", "", x.lower())
    want = {}
    for a in left:
        found = [b for b in right if norm(a) and norm(b) and (norm(a) in norm(b) or norm(b) in norm(a))]
        if found:
            want[a] = min(found, key=str.encode)
    rows = L.contained_names(names(spark, left), names(spark, right), often=often).collect()
    assert len(rows) == len(want) and {r["wanted"]: r["found"] for r in rows} == want


def test_contained_names_of_nothing(spark):
    none, one = names(spark, []), names(spark, ["a", None])
    assert L.contained_names(none, one).count() == L.contained_names(one, none).count() == L.contained_names(none, none).count() == 0
    assert [r["found"] for r in L.contained_names(one, one).collect()] == ["a"]
    assert {r["wanted"] for r in L.missing_files(names(spark, ["x1", "y", "z z"]), names(spark, ["X1.pdf", "zz"])).collect()} == {"y"}


def test_work_is_linear_where_names_share_a_front(spark):
    """Ten times the names make ten times the rows, though each is like every other in its first parts."""
    made = {}
    for n in (300, 3000):
        left = names(spark, [f"report of the year {k:06d} final" for k in range(n)])
        right = names(spark, [f"my report of the year {k:06d} final copy" for k in range(n)] + ["report"])
        df = L.contained_names(left, right)
        assert df.count() == n
        df.collect()
        plan, total = df._jdf.queryExecution().executedPlan(), 0
        for node in _nodes(plan):
            if "Join" in node.nodeName() or "Generate" in node.nodeName():
                m = node.metrics().get("numOutputRows")
                total += m.get().value() if m.isDefined() else 0
        made[n] = total
    assert made[3000] < 20 * max(made[300], 1)


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    if "QueryStage" in plan.nodeName():
        plan = plan.plan()
    out, children = [plan], plan.children()
    for k in range(children.size()):
        out += _nodes(children.apply(k))
    return out


def test_directories(spark):
    rng = random.Random(5)
    tail = lambda: "".join(rng.choices("ab", k=rng.randint(0, 5)))
    made = lambda: rng.choice(["folder ", "folder x", "f", "other thing "]) + tail() + rng.choice(["", "", " [vlm]", "(2)", " (3) [x]", "（4）"])
    wanted, found = {made() for _ in range(80)}, {made() for _ in range(60)}
    tagless = lambda x: re.sub(r"\s*\[[^\]]*\]\s*$", "", x.strip(" "))
    clean = lambda x: re.sub(r"\s*[(（]\d+[)）]\s*$", "", tagless(x))

    def near(a, b):
        a, b = sorted((clean(a), clean(b)), key=len)
        return len(a) >= 6 and b.startswith(a[: max(6, int(0.7 * len(a)))])

    want = {}
    for a in wanted:
        hits = [(k, b) for b in found for k, hit in enumerate((a == b, tagless(a) == tagless(b), clean(a) == clean(b), near(a, b))) if hit]
        if hits:
            want[a] = min(hits, key=lambda x: (x[0], x[1].encode()))
    rows = L.resolve_directories(names(spark, wanted), names(spark, found)).collect()
    assert {r["wanted"]: (r["rule"], r["found"]) for r in rows} == want and len({k for k, _ in want.values()}) == 4


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"k{k:04d}", 1) for k in random.Random(1).sample(range(5000), 1000)], "k string, granary_at int").repartition(5)
    got = sorted((r["no"], r["k"]) for r in L.numbered(rows, ["k"], "no").collect())
    assert [n for n, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)
    assert L.numbered(rows.limit(0), ["k"], "no").count() == 0
    assert {(r["k"], r["n"]) for r in L.next_numbers(spark.createDataFrame([("a", 7)], "k string, n long"), spark.createDataFrame([("c",), ("a",), ("b",)], "k string"), "k", "n").collect()} == {("b", 8), ("c", 9)}


def test_upsert_preserving_takes_nulls(spark):
    base = spark.createDataFrame([(1, "s", "n1"), (4, None, "n4")], "id long, state string, note string")
    new = spark.createDataFrame([(1, None, "n2"), (2, None, "n3"), (4, "t", None)], "id long, state string, note string")
    got = {tuple(r) for r in L.upsert_preserving(base, new, ["id"], []).collect()}
    assert got == {(1, None, "n2"), (2, None, "n3"), (4, "t", None)}
    assert {tuple(r) for r in L.upsert_preserving(base, new, ["id"], ["state"]).collect()} == {(1, "s", "n2"), (2, None, "n3"), (4, "t", None)}


def test_landing_of_pages_with_one_url(spark):
    pages = spark.createDataFrame([(k, None if k == 6 else "u", f"h{k}", True) for k in range(7)], "page_id long, url string, content_hash string, ok boolean")
    known = spark.createDataFrame([(0, 0, "h0"), (4, 4, "old")], "page_id long, id long, content_hash string")
    found = L.landing(pages, pages.where("page_id % 2 = 0"), known, ["page_id"]).collect()
    assert {r["page_id"]: r["action"] for r in found} == {0: "UNCHANGED", 2: "LANDED", 4: "LANDED", 6: "LANDED"}


def test_directories_of_keys_that_many_names_share(spark, monkeypatch):
    base = "annual report of the department for "
    wanted = names(spark, [f"{base}{k:08d}" for k in range(40)] + ["other things here 1", "other things here 12", "nothing like it"])
    there = names(spark, [f"{base}{k:08d} long" for k in range(100, 105)] + ["other things here", f"{base}7"])
    got = []
    for many in (3, 10**9):
        monkeypatch.setattr(L, "MANY", many)
        got.append(sorted(map(tuple, L.resolve_directories(wanted, there).collect())))
    assert got[0] == got[1] and len(got[0]) == 42


@pytest.mark.parametrize("lengths, fronts, many", [(0, 65_536, 20_000), (1, 0, 3), (8, 65_536, 3), (99, 0, 20_000)])
def test_contained_names_however_they_are_looked_up(spark, monkeypatch, lengths, fronts, many):
    monkeypatch.setattr(L, "FRONTS", fronts)
    monkeypatch.setattr(L, "MANY", many)
    rng = random.Random(lengths)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 20)))
    left, right = {word() for _ in range(150)}, {word() for _ in range(100)}
    want = {a: min(found) for a in left if (found := [b for b in right if a in b or b in a])}
    rows = L.contained_names(names(spark, left), names(spark, right), often=3, lengths=lengths).collect()
    assert len(rows) == len(want) and {r["wanted"]: r["found"] for r in rows} == want


def test_few_parts_of_names_are_sent(spark):
    """Names of few lengths that begin alike: about as many rows are shuffled as there are names, not one for each of their parts."""
    n, key = 2000, "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        left = names(spark, [f"report of the year {k:06d} final" for k in range(n)])
        df = L.contained_names(left, names(spark, [f"my report of the year {k:06d} final copy" for k in range(n)]))
        assert len(df.collect()) == n
        nodes = [x for x in _nodes(df._jdf.queryExecution().executedPlan()) if x.nodeName() == "Exchange"]
        assert sum(x.metrics().get("shuffleRecordsWritten").get().value() for x in nodes) < 8 * n
    finally:
        spark.conf.set(key, old)
