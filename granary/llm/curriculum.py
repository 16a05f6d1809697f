"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions alone.

A source's schedule gives its weight at each moment of training, from 0 to 1, as a line through knots; its integral is the
weight by which it shares the mix. Within a source documents follow the hash of their key, and are taken from the front until the source's
words are reached: as often as they go in whole, and once more as far as the rest goes, where the last document is cut. So every source gets its target to
the word. The middle of each visit stands at a part of the source's demand; the moment at which the integral of its schedule
reaches that part is the visit's position in training. Documents are sorted by position in ranges.

No task holds a source: its documents are dealt to 4,096 buckets by their hash, running sums go through the buckets' totals
first and within a bucket then. Only a row for each bucket that a source has is summed by source, and only a row for each source by all.

Defined results: a null size is 0, a document of size 0 is never taken; null is a source of its own, which comes last and is unlike the empty
string; rows are documents of their own, also with equal or null ids (equal rows are exchangeable); sources of size 0, and those whose
schedule is nowhere above 0, get nothing; a negative weight counts as 0; an empty table gives no row. Further columns are passed on; one named as an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import runtime

#: What the operator adds to the documents.
ADDED = ["source_size", "target", "taken", "position", "positions"]


def words(text: str = "text") -> Column:
    """The number of words in a text, parts between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def schedule(*knots: tuple[float, float]) -> Column:
    """A schedule through (moment, weight) knots, the first at 0 and the last at 1: array<struct<at,weight>>."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("knots must ascend from 0 to 1")
    return F.array(*(F.struct(F.lit(float(a)).alias("at"), F.lit(float(w)).alias("weight")) for a, w in knots))


def repeating(*schedules: Column) -> Column:
    """Schedules given to sources in turn, by their rank from 1."""
    out = None
    for k, s in enumerate(schedules):
        here = F.pmod(F.col("source_rank") - 1, F.lit(len(schedules))) == k
        out = F.when(here, s) if out is None else out.when(here, s)
    return out


#: In turn: level and then falling, rising, and even, of integrals 3, 1 and 2.
IN_TURN = (((0, 4), (0.5, 4), (1, 0)), ((0, 0), (1, 2)), ((0, 2), (1, 2)))


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: Column | None = None, schedules: Column | None = None, share: float = 1.5, most: int = 2) -> DataFrame:
    """Documents in the order of training, with what the mix takes of each.

    ``size`` names the words of a document, ``key`` gives its place within its source (by default the MD5 of ``doc_id``, else
    of ``text``, where the documents have them), ``schedules`` is an expression over ``source`` and ``source_rank``. The mix has ``share`` times all
    words; no source gets more than ``most`` times its own, and what is beyond goes to the others by weight.

    Adds source_size, target, taken (words, repeats counted), positions (a moment from 0 to 1 for each visit, in order) and
    position (that of the first visit, null if there is none). Rows come sorted by position, those never taken last.
    """
    schedules = repeating(*(schedule(*k) for k in IN_TURN)) if schedules is None else schedules
    n, spark = _names(docs), docs.sparkSession
    docs = docs.drop(*ADDED)
    if key is None:
        at = [F.col(c).cast("string") for c in ("doc_id", "text") if c in docs.columns]
        key = F.md5(F.coalesce(*at, F.lit("")).cast("binary"))
    # A source's name as a key without nulls, the bucket as the front of the hash.
    sized = docs.select("*", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias(n["size"]), key.alias(n["key"]), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias(n["group"]))
    sized = runtime.materialize(sized.withColumn(n["bucket"], F.substring(n["key"], 1, 3)), "curriculum")
    sums = sized.groupBy(n["group"], n["bucket"]).agg(F.sum(n["size"]).alias(n["sum"]), F.first(source).alias(n["source"]))
    sums = runtime.materialize(sums, "curriculum-buckets")
    wanted = targets(sums.groupBy(n["group"]).agg(F.sum(n["sum"]).alias("source_size"), F.first(n["source"]).alias("source")), schedules, share, most)
    wanted = wanted.select(F.col(n["group"]), "source_size", "target", F.struct("goal", "knots").alias(n["plan"]))
    before = F.sum(n["sum"]).over(Window.partitionBy(n["group"]).orderBy(n["bucket"]).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(n["group"], n["bucket"], F.coalesce(before, F.lit(0)).alias(n["start"])).join(wanted, n["group"])
    within = Window.partitionBy(n["group"], n["bucket"]).orderBy(n["key"], F.desc(n["size"])).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, [n["group"], n["bucket"]]).withColumn(n["start"], F.col(n["start"]) + F.coalesce(F.sum(n["size"]).over(within), F.lit(0)))
    goal, knots, all_, own = F.col(f"{n['plan']}.goal"), F.col(f"{n['plan']}.knots"), F.col("source_size"), F.col(n["size"])
    # Pass k of a source goes through all its words; that in which the goal ends takes the front only.
    taken = lambda k: F.greatest(F.least(goal - k * all_ - F.col(n["start"]), own), F.lit(0))
    passes = F.array(*(F.struct(taken(k).alias("words"), (k * all_ + F.col(n["start"]) + taken(k) / 2).alias("middle")) for k in range(most)))
    visits = F.filter(passes, lambda v: v["words"] > 0)
    out = placed.withColumn("taken", F.aggregate(passes, F.lit(0).cast("long"), lambda s, v: s + v["words"]))
    out = out.withColumn("positions", F.transform(visits, lambda v: _moment(knots, v["middle"] / goal)))
    out = out.withColumn("position", F.try_element_at("positions", F.lit(1)))
    out = out.orderBy(F.asc_nulls_last("position"), n["key"])  # untaken rows, which tie, are spread by their hash
    return out.select(*docs.columns, *ADDED)


def visits(mixed: DataFrame) -> DataFrame:
    """One row for each visit, sorted by its position: the columns of ``mix``, position being the visit's, and visit (from 1)."""
    rows = mixed.select(*(c for c in mixed.columns if c != "position"), F.posexplode("positions").alias("visit", "position"))
    return rows.withColumn("visit", F.col("visit") + 1).orderBy("position", "visit")


def targets(sources: DataFrame, schedules: Column, share: float = 1.5, most: int = 2) -> DataFrame:
    """sources(source, source_size, ...) with source_rank, weight, target, goal (the target in whole words) and knots.

    Sources are ranked by code points, null last. Targets are ``share`` of all words by weight; those above ``most`` times their source stop there and the
    excess is shared again by weight. In the order of limit for each weight the stopped ones come first, so running sums find them in one pass.
    One row for each source goes through a window: the sources are the only thing here that one task sees whole.
    """
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").cast("string").asc_nulls_last())))
    knots = F.transform(schedules, lambda k: F.struct(k["at"].alias("at"), F.greatest(k["weight"], F.lit(0.0)).alias("weight")))
    # For each segment: where it begins, its length, its weights, and the integral before it.
    lines = F.transform(F.sequence(F.lit(1), F.size("knots") - 1), lambda i: F.struct(
        F.element_at("knots", i)["at"].alias("at"), (F.element_at("knots", i + 1)["at"] - F.element_at("knots", i)["at"]).alias("length"),
        F.element_at("knots", i)["weight"].alias("a"), F.element_at("knots", i + 1)["weight"].alias("b")))
    area = lambda s: s["length"] * (s["a"] + s["b"]) / 2
    before = lambda s, i: F.aggregate(F.slice("lines", F.lit(1), i), F.lit(0.0), lambda x, y: x + area(y))
    ranked = ranked.withColumn("knots", knots).withColumn("lines", lines).withColumn("knots", F.transform("lines", lambda s, i: F.struct(s["at"].alias("at"), s["length"].alias("length"), s["a"].alias("a"), s["b"].alias("b"), before(s, i).alias("before"))))
    ranked = ranked.withColumn("weight", F.aggregate("lines", F.lit(0.0), lambda x, y: x + area(y))).drop("lines")
    cap, weight, everything = F.col("source_size") * most, F.col("weight"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.try_divide(cap, weight).asc_nulls_last(), "source_rank")
    total = share * F.sum(F.when(weight > 0, F.col("source_size")).otherwise(0)).over(everything)
    left = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    used = F.coalesce(F.sum(F.when(weight > 0, cap)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("total", total).withColumn("stopped", (weight == 0) | (cap * left <= (F.col("total") - used) * weight))
    free = F.sum(F.when(~F.col("stopped"), weight)).over(everything)
    spent = F.coalesce(F.sum(F.when(F.col("stopped") & (weight > 0), cap)).over(everything), F.lit(0))
    target = F.when(weight == 0, F.lit(0.0)).when(F.col("stopped"), cap.cast("double")).otherwise((F.col("total") - spent) * weight / free)
    return ranked.withColumn("target", target).withColumn("goal", F.least(F.floor(F.col("target") + 0.5), cap)).drop("total", "stopped")


def _moment(lines: Column, part: Column) -> Column:
    """The moment at which the integral of a schedule reaches a part of the whole, from 0 to 1."""
    area = lambda s: s["length"] * (s["a"] + s["b"]) / 2
    last = F.element_at(lines, -1)
    want = part * (last["before"] + area(last))
    # The last segment that begins below what is wanted; within it the root of a quadratic, in the form that is stable for level lines.
    s = F.coalesce(F.try_element_at(F.filter(lines, lambda x: (x["before"] < want) & (area(x) > 0)), F.lit(-1)), last)
    rest = F.greatest(want - s["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["a"] * s["a"] + 2 * (s["b"] - s["a"]) / s["length"] * rest, F.lit(0.0)))
    return F.least(s["at"] + F.least(F.coalesce(F.try_divide(2 * rest, s["a"] + root), F.lit(0.0)), s["length"]), F.lit(1.0))


def _names(docs: DataFrame) -> dict[str, str]:
    return {k: runtime.fresh(f"granary_{k}", docs) for k in ("size", "key", "group", "bucket", "sum", "source", "plan", "start")}
