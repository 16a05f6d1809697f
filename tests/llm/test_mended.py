"""Size classes of decontamination, short and long license templates, exact verification of near duplicates."""

import random

import numpy as np
import pytest

from granary.llm import decontam, licenses, simhash


def texts(n, seed, words=300):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(1, words))) for _ in range(n)]


def contained(items, text, threshold=0.8, width=5):
    own = decontam._words.findall(text.lower())
    out = {}
    for item, t in items:
        ids = decontam._words.findall(t.lower())
        w = min(width, len(ids))
        if w:
            grams = {tuple(ids[k : k + w]) for k in range(len(ids) - w + 1)}
            there = {tuple(own[k : k + w]) for k in range(len(own) - w + 1)}
            share = len(grams & there) / len(grams)
            if share >= threshold - 1e-12:
                out[item] = max(out.get(item, 0), share)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_size_classes_lose_nothing(threshold):
    rng = random.Random(2)
    items = list(enumerate(texts(150, 1, 60)))
    index = decontam.Index(items, 5, threshold)
    for k, text in enumerate(texts(60, 9, 400)):
        if k % 2:  # with part of an item amid it
            item = rng.choice(items)[1].split()
            cut = item[: max(1, int(len(item) * rng.choice([0.6, 0.85, 1])))]
            text = " ".join([text, *cut, text])
        got = {r[0]: r[1] for r in index.find(text)}
        assert got == pytest.approx(contained(items, text, threshold))


def test_classes_look_up_little(spark, sf):
    docs = spark.createDataFrame([(t,) for t in texts(200, 5, 400)], "text string")
    for n in (200, 3000):
        items = spark.createDataFrame(list(enumerate(texts(n, 1, 60))), "item_id long, text string")
        rows = decontam.pruning(docs, items).collect()
        assert len(rows) > 3 and all(r["found"] <= r["looked_up"] <= r["under_bound"] <= r["shingles"] for r in rows)
        long = [r for r in rows if r["width"] == 5]
        assert sum(r["looked_up"] for r in long) < 0.12 * sum(r["shingles"] for r in long)


def test_shared_hashes_take_another_seed(monkeypatch):
    plain, tried = decontam.Index._hashes, []

    def clash(self, columns):
        out = plain(self, columns)
        if len(tried) < 2 and columns.shape[1] > 1:
            tried.append(1)
            out[:2] = out[0]
        return out

    monkeypatch.setattr(decontam.Index, "_hashes", clash)
    index = decontam.Index([(1, "a b c d e f g"), (2, "h i j k l m")])
    assert len(tried) == 2
    monkeypatch.setattr(decontam.Index, "_hashes", plain)
    assert [r[0] for r in index.find("x h i j k l m y")] == [2]


def test_templates_of_any_length(spark, tmp_path):
    rng = random.Random(4)
    whole = " ".join(f"clause{rng.randint(0, 400)}" for _ in range(3000))
    (tmp_path / "long.txt").write_text(whole)
    (tmp_path / "tiny.txt").write_text("Copyleft")
    (tmp_path / "two.txt").write_text("free software")
    templates = licenses.from_folder(spark, tmp_path.as_uri())
    assert [n for n, _ in templates] == ["long", "tiny", "two"]
    changed = " ".join(w for k, w in enumerate(whole.split()) if k % 11)
    rows = [(1, f"before {whole} after"), (2, f"before {changed} after"), (3, "It is COPYLEFT, free software!"), (4, "free hard software"), (5, ""), (6, None), (7, "software"), (8, "copyleft")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["coverage"], 3), r["matched"]))
    assert got == {1: [("long", 1.0, 3000)], 2: [("long", round(len(changed.split()) / 3000, 3), len(changed.split()))], 3: [("tiny", 1.0, 1), ("two", 1.0, 2)], 8: [("tiny", 1.0, 1)]}
    with pytest.raises(ValueError):
        licenses.from_folder(spark, tmp_path.as_uri(), most=100)


def test_verification_is_exact():
    rng = random.Random(8)
    base = [f"a{k}" for k in range(120)]
    made = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"b{rng.randint(0, 9)}"
        made.append(" ".join(words))
    made += ["", "", "a b", "a b", "a"]
    sets = [simhash.shingle_set(x, 5) for x in made]

    def parts(links, n):
        group = list(range(n))
        for a, b in links:
            group = [group[b] if g == group[a] else g for g in group]
        return {frozenset(k for k in range(n) if group[k] == g) for g in set(group)}

    want = [(i, j) for i in range(len(sets)) for j in range(i) if simhash._similar_sets(sets[i], sets[j])]
    n = len(made)
    a, b = simhash._verify(made, np.arange(n), np.zeros(n, np.int8), 5, False)
    assert parts(zip(a.tolist(), b.tolist()), n) == parts(want, n)
    # Side 0 against side 1, whose members are joined already.
    half = 40
    a, b = simhash._verify(made, np.arange(n), np.array([0] * half + [1] * (n - half), np.int8), 5, True)
    across = {i for i in range(half) for j in range(half, n) if simhash._similar_sets(sets[i], sets[j])}
    assert {x for pair in zip(a.tolist(), b.tolist()) for x in pair if x < half} == across


def test_near_copies_come_from_the_trees(spark, monkeypatch):
    """Whatever else is found, texts whose fingerprints differ in four bits at most meet by the trees, and are grouped where their similarity is exact."""
    rng = np.random.default_rng(21)
    rows = {}
    for k in range(80):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(100, 300)))]
        rows[k] = " ".join(words)
        words[int(rng.integers(len(words)))] = "changed"
        rows[1000 + k] = " ".join(words)
    fp = {k: int.from_bytes(simhash.set_signature(simhash.shingle_set(x), 1), "little") for k, x in rows.items()}
    near = {k for k in range(80) if (fp[k] ^ fp[1000 + k]).bit_count() <= 4}
    assert 20 < len(near) < 80
    points = spark.createDataFrame([(k, x - (x >> 63 << 64)) for k, x in fp.items()] + [(5000, fp[0] - (fp[0] >> 63 << 64))], "rep long, fp long")
    assert {frozenset((r["a"], r["b"])) for r in simhash.tree_links(points).collect()} >= {frozenset((k, 1000 + k)) for k in near} | {frozenset((0, 5000))}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    monkeypatch.setattr(simhash, "candidates", lambda points: spark.createDataFrame([], "a long, b long"))
    kept = {r["doc_id"] for r in simhash.distinct_documents(docs).collect()}
    assert kept == rows.keys() - {1000 + k for k in near}
