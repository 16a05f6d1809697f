"""Crawls against a queue: attachments to its front, paging without depth, the cap, seeds that are wrong, pages that fail."""

import random
from collections import deque

import pytest

from granary.operators import crawl


def queue_crawl(seeds, edges, depth, pages, failed):
    """The order in which a queue visits one profile's pages."""
    queue, met, items = deque(), set(), 0
    for s in seeds:
        if s in met or not s.startswith("http://x/"):
            items += 1
        else:
            met.add(s)
            queue.append((s, 0, s, True))
    cap, out = max(len(seeds), pages), []
    while queue:
        url, d, seed, first = queue.popleft()
        if not first and items >= cap:
            break
        ok = url not in failed
        if first or ok:
            items += 1
            out.append((url, d))
        if not ok or url.endswith(".pdf") or d >= depth:
            continue
        front, back = [], []
        for link in edges.get(url, []):
            path, root = link.split("?")[0].removeprefix("http://x"), seed.split("?")[0].removeprefix("http://x").rstrip("/")
            if link in met or not (link.endswith(".pdf") or path.rstrip("/") == root or path.startswith((root + "/", root + "_"))):
                continue
            met.add(link)
            free = path.rstrip("/") == url.split("?")[0].removeprefix("http://x").rstrip("/")
            (front if link.endswith(".pdf") else back).append((link, d + (0 if free else 1), seed, False))
        queue.extendleft(reversed(front))
        queue.extend(back)
    return out


@pytest.mark.parametrize("pages", [1, 7, 25, 200])
def test_against_a_queue(spark, pages):
    rng = random.Random(pages)
    urls = [f"http://x/{c}{tail}" for c in ("news/", "news/a", "news/b", "other") for tail in ("", "?p=2", "?p=3", "/1", "/2", "/3", "/f.pdf", "/g.pdf")]
    edges = {u: rng.sample(urls, 6) for u in urls}
    failed = set(rng.sample(urls, 5))
    profiles = {"a": ["http://x/news/", "http://x/news/", "ftp://no", "", "http://x/other"], "b": ["http://x/news/a", "http://x/other/f.pdf", "http://x/news/b?p=2"], "c": ["http://x/other"]}
    seeds = spark.createDataFrame([(p, s, k) for p, ss in profiles.items() for k, s in enumerate(ss)], "profile string, seed string, ord int")
    links = spark.createDataFrame([(u, v, k) for u, vs in edges.items() for k, v in enumerate(vs)], "url string, link string, ord int")
    for depth in (0, 1, 2, 5):
        rows = crawl.visits(seeds, links, depth, pages, failed=spark.createDataFrame([(u,) for u in failed], "url string")).orderBy("profile", "ord").collect()
        for p, ss in profiles.items():
            got = [(r["url"], r["depth"]) for r in rows if r["profile"] == p]
            assert got == queue_crawl(ss, edges, depth, pages, failed)
            assert [r["ord"] for r in rows if r["profile"] == p] == list(range(1, len(got) + 1))


def test_paging_costs_no_depth(spark):
    chain = ["http://x/p"] + [f"http://x/p?page={k}" for k in range(2, 6)]
    links = spark.createDataFrame([(a, b, 0) for a, b in zip(chain, chain[1:])], "url string, link string, ord int")
    seeds = spark.createDataFrame([("", "http://x/p", 0)], "profile string, seed string, ord int")
    assert [(r["url"], r["depth"]) for r in crawl.visits(seeds, links, 1).orderBy("ord").collect()] == [(u, 0) for u in chain]
    assert crawl.visits(seeds, links, 1, scope="host").count() == 2


def test_wrong_seeds(spark):
    seeds = spark.createDataFrame([("p", s, k) for k, s in enumerate(["http://x/a", " ", None, "ftp://x", "http://X/a#t", "http://y/a"])], "profile string, seed string, ord int")
    got = {r["ord"]: r["error"] for r in crawl.seed_errors(seeds, ["x"]).collect()}
    assert got == {0: None, 1: "empty", 2: "empty", 3: "scheme", 4: "repeated", 5: "not allowed"}
    none = spark.createDataFrame([], "url string, link string, ord int")
    assert [r["url"] for r in crawl.visits(seeds, none, allowed=["x"]).collect()] == ["http://x/a"]
    assert crawl.visits(seeds.limit(0), none).count() == 0


def test_no_join_of_a_crawl_goes_through_the_driver(spark):
    seeds = spark.createDataFrame([("p", "http://x/a", 0)], "profile string, seed string, ord int")
    edges = spark.createDataFrame([("http://x/a", "http://x/a/b", 0)], "url string, link string, ord long")
    out = crawl.visits(seeds, edges, max_depth=1, failed=spark.createDataFrame([("http://x/z",)], "url string"))
    assert [r["url"] for r in out.orderBy("ord").collect()] == ["http://x/a", "http://x/a/b"] and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
