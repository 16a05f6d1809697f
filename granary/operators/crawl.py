"""Crawls over an edge table: hop by hop, in the order of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary import runtime
from granary.functions import text as X


def url_denied(url: Column, allowed: list[str]) -> Column:
    """Why a URL may not be fetched, or null. An entry is a prefix if it has a scheme, else a host."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), X.host_key(url)
    ok = F.lit(not allowed)
    for a in allowed:
        ok = ok | (F.startswith(url, F.lit(a)) if "://" in a else (host == a.lower().removeprefix("www.")) | F.endswith(host, F.lit("." + a.lower().removeprefix("www."))))
    return F.when(scheme.isNull() | ~scheme.isin("http", "https"), "scheme").when(host.isNull() | (host == ""), "host").when(~ok, "not allowed")


#: Columns of what crawls visit.
VISIT = ["profile", "ord", "url", "depth", "seed", "is_seed", "hop", "path"]


def visits(seeds: DataFrame, edges: DataFrame, max_depth: int = 2, max_pages: int = 20, scope: str = "column", allowed: list[str] | None = None, failed: DataFrame | None = None) -> DataFrame:
    """What crawls visit: profile, ord (from 1 in each), url, depth, seed, is_seed, hop, path.

    ``seeds(profile, seed, ord)``, one crawl for each profile, all at once; ``edges(url, link, ord)`` of normal addresses; ``failed(url)`` cannot be fetched. The
    order of a queue is a key: the number of hops, then the path of places from the seed. A page's attachments keep its hop, and their path goes on
    from its own, so they come right behind it and before the next page; other links come after all of the hop. A link belongs to the page that meets it
    first. Following it costs one of depth, but paging within a column, which changes nothing of the path, costs none: hops go on until no page is left
    or the cap is reached.

    Every seed counts, also one that is denied, repeated or failed (``seed_errors`` names those); other pages count once they are fetched. At ``max_pages``
    (at least the seeds) a crawl ends before the next that is no seed. A hop is an equi-join with the edges and an anti-join with what was met; its table has no more
    pages of a crawl than the cap, and as many attachments.
    """
    max_depth, max_pages, allowed = max(0, min(5, max_depth)), max(1, min(200, max_pages)), allowed or []
    checked = runtime.materialize(_normal_seeds(seeds, allowed), "crawl-seeds")
    counts = checked.groupBy("profile").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.greatest(F.count("*"), F.lit(max_pages)).alias("cap"))
    counts = runtime.materialize(counts, "crawl-profiles")
    start = checked.where("error is null").select("profile", "url", F.lit(0).alias("depth"), F.col("url").alias("seed"), F.lit(True).alias("is_seed"), F.lit(0).alias("hop"), F.array(F.col("ord").cast("long")).alias("path"))
    met = level = runtime.materialize(start, "crawl")
    attached = X.is_attachment(F.col("url"))
    bare = lambda c: F.regexp_replace(X.url_path(F.col(c)), "/+$", "")
    free = (bare("url") == bare("from")) if scope == "column" else F.lit(False)
    denied = url_denied(F.col("url"), allowed).isNotNull() if allowed else F.lit(False)
    # Stored tables are small and unfold to many times their size: no join may take one for small and send it through the driver.
    far = lambda df: df.hint("merge")
    lost = lambda rows: rows if failed is None else rows.join(far(failed.select("url")), "url", "left_anti")
    hop = 0
    while True:
        pages = lost(level.where((F.col("depth") < max_depth) & ~attached))
        steps = far(pages).alias("f").join(far(edges).alias("e"), "url").select("f.profile", F.col("e.link").alias("url"), F.col("f.url").alias("from"), "f.depth", "f.seed", F.concat(F.col("f.path"), F.array(F.col("e.ord").cast("long"))).alias("path"))
        steps = lost(steps.where(X.site_scope(F.col("url"), F.col("seed"), scope) & ~denied).join(far(met.select("profile", "url")), ["profile", "url"], "left_anti"))
        first = steps.groupBy("profile", "url").agg(F.min(F.struct("path", "from", "depth", "seed")).alias("m")).select("profile", "url", "m.*")
        rows = first.select("profile", "url", (F.col("depth") + F.when(free, 0).otherwise(1)).alias("depth"), "seed", F.lit(False).alias("is_seed"), (F.lit(hop) + F.when(attached, 0).otherwise(1)).alias("hop"), "path")
        # More than the cap of either kind is never visited.
        at = F.row_number().over(Window.partitionBy("profile", "hop").orderBy("path", "url"))
        found = rows.withColumn("at", at).join(far(counts), "profile").where("at <= cap").select(*met.columns)
        found = runtime.materialize(found, "crawl")
        if found.isEmpty():
            break
        met, hop = met.unionByName(found), hop + 1
        # Hops before the last are complete: where they reach the cap, the crawl is over.
        over = met.where(F.col("hop") < hop).groupBy("profile").agg(F.count("*").alias("n")).join(far(counts), "profile").where("n + errors >= cap")
        level = found.where(F.col("hop") == hop).join(far(over.select("profile")), "profile", "left_anti")
    order = Window.partitionBy("profile").orderBy("hop", "path", "url")
    rows = met.withColumn("ord", F.row_number().over(order).cast("long")).join(far(counts), "profile")
    late = F.min(F.when(~F.col("is_seed") & (F.col("ord") - 1 + F.col("errors") >= F.col("cap")), F.col("ord"))).over(Window.partitionBy("profile"))
    return rows.withColumn("end", late).where("end is null or ord < end").select(*VISIT)


def _normal_seeds(seeds: DataFrame, allowed: list[str]) -> DataFrame:
    """Seeds with their normal address, and what is wrong with each; of equal addresses of a profile the first is right."""
    given = F.btrim(F.coalesce("seed", F.lit("")))
    rows = seeds.select("profile", "seed", "ord", X.normalize_url(given).alias("url"))
    rows = rows.withColumn("error", F.when(F.length(given) == 0, "empty").when(F.col("url") == "", "scheme").otherwise(url_denied(F.col("url"), allowed)))
    again = F.row_number().over(Window.partitionBy("profile", "url", "error").orderBy("ord")) > 1
    return rows.withColumn("error", F.when(F.col("error").isNull() & again, "repeated").otherwise(F.col("error")))


def seed_errors(seeds: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(profile, seed, ord, error): why a seed is not crawled (empty, its scheme, host or address not allowed, repeated), or null."""
    return _normal_seeds(seeds, allowed or []).select("profile", "seed", "ord", "error")


def crawl(spark: SparkSession, seeds: DataFrame, edges: DataFrame, max_depth: int = 2, max_pages: int = 20, scope: str = "column") -> DataFrame:
    """(url, depth, seed, ord) of ``visits`` of one crawl of ``seeds(seed, ord)``; a seed keeps its own ord."""
    ord_ = F.when(F.col("is_seed"), F.element_at("path", 1)).otherwise(F.col("ord"))
    return visits(seeds.withColumn("profile", F.lit("")), edges, max_depth, max_pages, scope).select("url", "depth", "seed", ord_.alias("ord"))
