"""Spelling variants against brute force over whole tables, and the trie join on made vocabularies with every size of trie."""

import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, shortest=6, least=5):
    counts = Counter()
    for id_, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near_of(words):
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add((w, k))
    pairs = set()
    for hole, found in holes.items():
        if hole in words:
            pairs |= {(w, hole) for w, _ in found} | {(hole, w) for w, _ in found}
        pairs |= {(a, b) for a, i in found for b, j in found if i == j and a != b}
    return pairs


def brute(words):
    near = {w: [] for w in words}
    for a, b in near_of(words):
        near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, size):
    sf = f"/root/testdata/{size}"
    want = brute(words_of(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert got(queries.op12_spelling(spark, sf)) == want and any(x[1] for x in want)


@pytest.mark.parametrize("most", [1, 3, 50, 4096])
def test_tries_of_any_size(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 9))): rng.randint(5, 900) for _ in range(900)}
    words |= {"commonfrontpart" + "".join(rng.choices("xy", k=5)): 7 for _ in range(60)} | {"".join(rng.choices("xy", k=5)) + "commonending": 9 for _ in range(60)}
    words |= {"aaaaaa": 5, "aaaaaaa": 6, "aaaaaaaa": 7, "ab" * 900: 8, "ab" * 900 + "a": 50, "b" + "ab" * 900: 9}
    found = [(r["word"], r["near"]) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), most).collect()]
    assert len(found) == len(set(found)) and set(found) == near_of(words)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    texts = [None, "", "12 ab", "Colour COLOUR colour color " * 40, "colours " * 9, "Ünïcode ünïcode Ünïcode", "日本語colour語", "x×÷yabc " * 6, "w" * 30_000, "w" * 29_999 + "v"]
    rows = [(k if k % 4 else None, t) for k, t in enumerate(texts * 5)]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n long, word string")
    assert got(spelling.variants(docs)) == brute(words_of(rows))
    assert spelling.variants(docs.limit(0)).count() == 0


def test_chains_lead_to_one_root(spark):
    words = {"abcdefgh"[: 6 + k % 3] + "z" * (k // 3): 5 * 6**k for k in range(6)}
    words |= {"lettersa": 5, "lettersb": 25, "lettersc": 25}
    docs = spark.createDataFrame([(1, " ".join(w for w, n in words.items() for _ in range(n)))], "doc_id long, text string")
    assert got(spelling.variants(docs)) == brute(words_of([(1, docs.first()["text"])]))
