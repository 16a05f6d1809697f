"""How the sources of a language differ in their words: an audit by smoothed shares, in whole numbers.

Terms are runs of letters and characters beyond ASCII, with A-Z in lower case. A language keeps the terms that ``least`` of its
documents have. A group (language and source), and a language as a whole, gives each kept term the share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by floor((p - q)^2 / (p + q)).

Pairs are sparse: a term that neither source has gives both their baselines, the share of a count of 0, so all V terms count at the
baselines first, and only terms that a source has correct that. Terms of one source alone have few different
shares, so they come from its histogram of counts; those of both come from one pass over the terms, in which a worker sums by pair of sources
and hands on what it has when it holds ``HELD`` pairs.

The first ``top`` terms of a group are found by radix selection: histograms over bits of the values, from the highest, find the top-th value of
each group, and where more terms tie there than are wanted, histograms over their UTF-8 bytes find the last of them. No group is sorted whole.

Defined results: null text, language and source are empty strings; a text without a term still counts its group; repeated rows are documents of their own; ids take no
part; a language without kept terms has pairs of value 0 and no term rows; a source alone in its language has no pair; very long terms are terms like others; an empty table gives
no row; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import runtime

#: Bytes of no term end one; A-Z go to lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Different terms, and pairs of sources, that a worker sums before it hands them on.
HELD = 200_000
#: Values are below 2^30: three rounds of ten bits.
BITS, DIGIT = 30, 10
#: UTF-8 bytes of a round among ties, after those that all ties of a group share.
BYTES = 2


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the other sources of the language, part ``term`` the ``top`` terms that a source has beyond its language's share."""
    counts, groups = _counted(docs)
    kept = runtime.materialize(_kept(counts, least), "divergence-kept")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("terms"))
    lang_sums = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("n_all"), F.count("*").alias("V"))
    langs = langs.join(lang_sums, "lang", "left").select("lang", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("V", F.lit(0)).alias("V"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("terms", F.lit(0)).alias("terms"), "n_all", "V")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("int")
    groups = groups.withColumn("base", share(F.lit(0), F.col("n_group"), F.col("V"))).withColumn("no", number)
    groups = runtime.materialize(groups, "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group"), F.col("V")))
    return pairs(groups, shares).unionByName(terms(shares, top))


def share(count: Column, everything: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), in decimals, so exact for any corpus; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * whole(count + 2)
    return F.when(kept > 0, 1 + F.call_function("div", over, whole(everything + 2 * kept)))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): shares are at most 10^9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, docs) over all documents, and all (lang, source) groups."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    name = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    part = docs.select(text, name("lang"), name("source")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    summed = part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = runtime.materialize(summed, "divergence-counts")
    return summed.where("term is not null"), summed.where("term is null").select("lang", "source")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a row without a term names a group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out():
        rows = [(g, c, d) for g, (c, d) in held.items()]
        groups = [g for g, c, _ in rows for _ in range(len(c) + 1)]
        words = [w for _, c, _ in rows for w in (None, *c)]
        n = [x for _, c, _ in rows for x in (0, *c.values())]
        docs = [x for _, c, d in rows for x in (0, *(d[w] for w in c))]
        columns = [pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        yield from pa.table(columns, ["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=50_000)
        held.clear()

    for batch in batches:
        for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = Counter(text.as_py().translate(_FOLD).split())
            n.update(found)
            d.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def _kept(counts: DataFrame, least: int) -> DataFrame:
    """Counts of kept terms with the language's. A window holds a term of a language: one row for each source at most."""
    over = Window.partitionBy("lang", "term")
    rows = counts.withColumn("all", F.sum("docs").over(over)).withColumn("n_lang", F.sum("n").over(over))
    return rows.where(F.col("all") >= least).select("lang", "source", "term", "n", "n_lang")


# --- pairs of sources ------------------------------------------------------------------------------


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """The rows of part ``pair``, whose number is that of the pairs of sources of a language, as asked for."""
    a, b = (groups.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "no", "terms", "base")), *(["V"] if x == "a" else [])) for x in "ab")
    # Terms of a source alone, by their different counts, against the baseline of each other source.
    counts = shares.groupBy("lang", F.col("no").alias("no_a"), "p").agg(F.count("*").alias("k"))
    one = counts.join(groups.select("lang", F.col("no").alias("no_b"), F.col("base")), "lang").where("no_a <> no_b")
    one = one.groupBy("lang", "no_a", "no_b").agg(F.sum(F.col("k") * apart(F.col("p"), F.col("base"))).alias("alone"))
    # Terms of both, each pair once.
    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "base")).alias("found")).where("size(found) > 1")
    both = by_term.select("lang", "found").mapInArrow(_meet, "lang string, no_a int, no_b int, terms long, more long")
    both = both.groupBy("lang", "no_a", "no_b").agg(F.sum("terms").alias("shared"), F.sum("more").alias("more"))
    both = both.unionByName(both.select("lang", F.col("no_b").alias("no_a"), F.col("no_a").alias("no_b"), "shared", "more"))
    # All three are brought to a pair by one aggregate: what a source has alone counts for either direction.
    parts = one.select("lang", "no_a", "no_b", "alone", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("more"))
    parts = parts.unionByName(one.select("lang", F.col("no_b").alias("no_a"), F.col("no_a").alias("no_b"), "alone", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("more")))
    parts = parts.unionByName(both.select("lang", "no_a", "no_b", F.lit(0).cast("long").alias("alone"), "shared", "more"))
    parts = parts.groupBy("lang", "no_a", "no_b").agg(*(F.sum(c).alias(c) for c in ("alone", "shared", "more")))
    every = a.join(b, "lang").where("no_a <> no_b").join(parts, ["lang", "no_a", "no_b"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = F.col("V") - F.col("terms_a") - F.col("terms_b") + none("shared")
    value = F.coalesce(rest * apart(F.col("base_a"), F.col("base_b")), F.lit(0)) + none("alone") + none("more")
    rows = every.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of sources of a language (the smaller number first): terms of both, and what they add to what each had alone."""
    langs: dict[str, int] = {}
    names: list[str] = []
    held = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)

    def merged(keys, sums):
        order = np.lexsort(keys.T[::-1])
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(sums, first, axis=0) if len(first) else sums

    def out(keys, sums):
        columns = [pa.array([names[k] for k in keys[:, 0].tolist()], pa.string()), pa.array(keys[:, 1], pa.int32()), pa.array(keys[:, 2], pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
        yield from pa.table(columns, ["lang", "no_a", "no_b", "terms", "more"]).to_batches(max_chunksize=50_000)

    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for batch in batches:
        found = batch.column(1)
        cuts = found.offsets.to_numpy()
        flat = found.values
        no, p, base = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        for x in batch.column(0).unique().to_pylist():
            if x not in langs:
                langs[x] = len(names)
                names.append(x)
        lang = np.array([langs[x] for x in batch.column(0).to_pylist()], np.int64)
        # Each entry meets the later entries of its term, one at a time in portions, so that no more than a portion of pairs exists at once.
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(cuts[0], cuts[-1]) - 1
        begin = 0
        while begin < len(row):
            end = begin + max(1, int(np.searchsorted(np.cumsum(left[begin:]), 500_000)))
            n = left[begin:end]
            a = np.repeat(np.arange(begin, begin + len(n)), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            a, b, r = a + cuts[0], b + cuts[0], row[a]
            low, high = np.minimum(no[a], no[b]), np.maximum(no[a], no[b])
            more = f(p[a], p[b]) - f(p[a], base[b]) - f(p[b], base[a])
            keys, sums = merged(np.stack([lang[r], low, high], 1), np.stack([np.ones(len(a), np.int64), more], 1))
            held = merged(np.concatenate([held[0], keys]), np.concatenate([held[1], sums]))
            if len(held[0]) > HELD:
                yield from out(*held)
                held = held[0][:0], held[1][:0]
            begin = end
    yield from out(*held)


# --- the first terms of a group ----------------------------------------------------------------------


def terms(shares: DataFrame, top: int) -> DataFrame:
    """The rows of part ``term``."""
    q = share(F.col("n_lang"), F.col("n_all"), F.col("V"))
    rows = shares.where("n > 0").withColumn("q", q).where("p > q").select("lang", "source", "term", apart(F.col("p"), F.col("q")).alias("value"))
    rows = runtime.materialize(rows, "divergence-terms")
    best = selected(rows, ["lang", "source"], "value", "term", top)
    out = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))  # at most ``top`` rows


def selected(rows: DataFrame, group: list[str], value: str, item: str, top: int) -> DataFrame:
    """Of each group the ``top`` rows by value (0 to 2^30 - 1), largest first, then by item in UTF-8 order; items of a group are unlike.

    A round counts the rows of each digit among those that agree with the threshold so far, and goes on in the digit at which
    ``top`` is reached; a group with ``top`` rows or fewer ends at the lowest digit.
    """
    bound = rows.groupBy(*group).agg(F.least(F.count("*"), F.lit(top)).alias("want")).withColumn("front", F.lit(0).cast("long"))
    for low in range(BITS - DIGIT, -1, -DIGIT):
        near = rows.join(bound, group).where(F.shiftright(value, low + DIGIT) == F.col("front")).withColumn("front", F.shiftright(value, low))
        bound = runtime.materialize(_crossing(near, bound, group, F.desc("front")), f"divergence-bits-{low}")
    above = rows.join(bound, group)
    taken = above.where(F.col(value) > F.col("front")).select(*rows.columns)
    ties = above.where(F.col(value) == F.col("front")).select(*rows.columns, "want")
    while True:
        ties = runtime.materialize(ties, "divergence-ties")
        tied = ties.groupBy(*group).agg(F.first("want").alias("want"), F.count("*").alias("tied"), F.min(item).alias("least"), F.max(item).alias("most"))
        tied = runtime.materialize(tied, "divergence-tied")
        taken = taken.unionByName(ties.join(tied.where("tied <= want").select(*group), group, "left_semi").select(*rows.columns))
        many = tied.where("tied > want")
        if many.isEmpty():
            return taken
        # More ties than places: the bytes at which the last place is reached. What the least and the greatest item share, all share.
        least, most = F.col("least").cast("binary"), F.col("most").cast("binary")
        same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.octet_length(least), F.octet_length(most))), lambda n: F.substring(least, F.lit(1), n) == F.substring(most, F.lit(1), n)))
        many = many.select(*group, F.col("want").alias("places"), same.alias("at"))
        near = ties.join(many, group).withColumn("front", F.substring(F.col(item).cast("binary"), F.col("at") + 1, F.lit(BYTES)))
        edge = _crossing(near, many.withColumnRenamed("places", "want"), group, F.asc("front")).withColumnsRenamed({"want": "still", "front": "edge"})
        near = near.join(runtime.materialize(edge, "divergence-edges"), group)
        taken = taken.unionByName(near.where("front < edge").select(*rows.columns))
        ties = near.where("front = edge").select(*rows.columns, F.col("still").alias("want"))


def _crossing(near: DataFrame, wanted: DataFrame, group: list[str], order: Column) -> DataFrame:
    """(group, want, front): the digit at which a group's wanted number is reached, and how many of it are wanted."""
    counted = near.groupBy(*group, "front").agg(F.count("*").alias("k"))
    over = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("k").over(over), F.lit(0))).join(wanted.select(*group, "want"), group)
    return counted.where("before < want and before + k >= want").select(*group, (F.col("want") - F.col("before")).alias("want"), "front")
