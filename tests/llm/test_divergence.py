"""The divergence audit against SQL and against brute force, with ties, odd rows and small bounds."""

import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect

from granary.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", a or "", s or "") for _, t, a, s in rows):
        found = TERM.findall(text.translate(LOW))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= least}
        groups = {s: {t: c[t] for t in kept} for (a, s), c in counts.items() if a == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in groups.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(shares[s][t], q[t]), t) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)}
    return out


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, value long, `n a` string").repartition(3)
    out = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, **more).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    found, want = compare(spark, sf, connect(sf), queries.op13_divergence, queries.OP13_SQL)
    assert found == want


def test_odd_rows(spark):
    rows = [(1, None, "x", None), (1, "", None, "s"), (None, "Ärger ÄRGER É é a-b_c 12 A z", "x", "s"), (2, "日本 日本語 " * 3000, "x", "t"), (2, "日本 日本語 " * 3000, "x", "t"), (3, "a b\x00c\x7fd", "x", ""), (4, "lone", "alone", "s")]
    assert got(spark, rows, least=1, top=3) == brute(rows, 1, 3)
    assert got(spark, rows, least=2, top=3) == brute(rows, 2, 3)
    assert got(spark, rows, least=9) == brute(rows, 9)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("held", [20, 200_000])
def test_ties_refine_by_bytes(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(3)
    letters = ["a", "b", "é", "日", "\U0001f600"]
    words = sorted({"shared" + "".join(rng.choices(letters, k=rng.randint(0, 6))) for _ in range(300)})
    rows = [(k, " ".join(rng.sample(words, 60) + words[:40]), "l", f"s{k % 3}") for k in range(30)]
    rows += [(k, " ".join(words), "m", "t") for k in range(3)] + [(k, "other text", "m", f"u{k % 2}") for k in range(4)]
    for top in (1, 7, 10):
        assert got(spark, rows, least=2, top=top) == brute(rows, 2, top)
