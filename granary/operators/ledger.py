"""The ledger: upserts, lookups, matches, set operations, pages and reports, all as joins and aggregates.

Tables have no update in place: an upsert is a new version of the table. Match cascades are equi-joins
of a fixed priority; matches by prefix and by containment are lookups in an index of prefixes and parts of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import runtime


def last_write(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: that written last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return updates.withColumn("granary_rank", F.row_number().over(w)).where("granary_rank = 1").drop("granary_rank")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates, and what they do not replace. ``updates`` has one row for each key."""
    return base.join(updates, keys, "left_anti").unionByName(updates.select(*base.columns))


def upsert_preserving(base: DataFrame, updates: DataFrame, keys: list[str], preserved: list[str]) -> DataFrame:
    """Updates whose ``preserved`` columns keep the value of the row they replace, if it is not null; nulls of an update are values like others. ``updates`` has one row for each key, and all columns."""
    mark = runtime.fresh("granary_seen", base)
    old, new = base.alias("o"), updates.withColumn(mark, F.lit(True)).alias("n")
    joined = old.join(new, keys, "full_outer")
    seen = F.col(f"n.{mark}").isNotNull()
    return joined.select(*keys, *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in preserved else F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in base.columns if c not in keys))


def update_present(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows with the values of an update that are neither null nor blank; rows are neither added nor lost."""
    old, new = base.alias("o"), updates.alias("n")
    value = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}").cast("string"), F.lit("")).cast(base.schema[c].dataType), F.col(f"o.{c}"))
    return old.join(new, keys, "left").select(*keys, *((value(c) if c in updates.columns else F.col(f"o.{c}")).alias(c) for c in base.columns if c not in keys))


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys, on, "left_anti")


def fetch(base: DataFrame, filename: str, tenant: str | None = None) -> DataFrame:
    """The row of a file: the tenant's, or that of the default tenant first."""
    rows = base.where(F.col("filename") == filename)
    if tenant:
        return rows.where(F.col("tenant_id") == tenant).limit(1)
    return rows.orderBy((F.col("tenant_id") == "default").desc(), "tenant_id").limit(1)


def visible_rows(base: DataFrame, tenant: str, default: str = "default") -> DataFrame:
    """A named tenant sees its own rows, the default tenant all."""
    return base if tenant == default else base.where(F.col("tenant_id") == tenant)


def page(base: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the ledger, newest first; null times come last."""
    return base.orderBy(F.coalesce("update_time", F.lit("")).desc(), F.col("filename").desc()).offset(offset).limit(limit)


def recent(base: DataFrame, order: str, limit: int) -> DataFrame:
    """The newest rows, from 1 to 500 of them."""
    return base.orderBy(F.desc(order)).limit(max(1, min(limit, 500)))


def latest(base: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, by one partial aggregate."""
    rest = [c for c in base.columns if c not in keys]
    return base.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def cascade(left: DataFrame, right: DataFrame, rules: list[tuple[Column, Column]], left_key: str, right_key: str, order: str) -> DataFrame:
    """The match of each left row by the first rule that has one; among equals that with the least ``order``.

    A rule is a pair of expressions that are equal: every step is an equi-join.
    """
    out = None
    for n, (a, b) in enumerate(rules):
        lhs = left.select(F.col(left_key).alias("left_key"), a.alias("on_key")).where("on_key is not null and on_key <> ''")
        rhs = right.select(F.col(right_key).alias("right_key"), F.col(order).alias("rank"), b.alias("on_key")).where("on_key is not null and on_key <> ''")
        found = lhs.join(rhs, "on_key").select("left_key", F.struct(F.lit(n).alias("rule"), F.col("rank"), F.col("right_key")).alias("m"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("left_key").agg(F.min("m").alias("m")).select("left_key", F.col("m.right_key").alias("right_key"), F.col("m.rule").alias("rule"))


def clean_stem(stem: Column) -> Column:
    """A directory name without tags in brackets or a copy number."""
    return F.regexp_replace(F.regexp_replace(F.btrim(stem), r"\s*\[[^\]]*\]\s*$", ""), r"\s*[(（]\d+[)）]\s*$", "")


#: Names of a key above which it is sent to them: there is at most one such key for as many rows.
MANY = 20_000


def resolve_directories(wanted: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """wanted name -> existing directory: exact, without tags, without copy numbers, else 70 % of the shorter clean name (6 at least) as a prefix; the least name of the first rule that has one.

    Directories are reduced to the least name for each key, and for the prefix rule for each prefix and length, before they are joined, so a name
    meets one row for each of its prefixes however many directories share them. A prefix that many names share is sent to them, so that no task has all of them.
    """
    w, e = wanted.select(F.col(name).alias("wanted")).distinct(), existing.select(F.col(name).alias("found")).distinct()
    tagless = lambda c: F.regexp_replace(F.btrim(c), r"\s*\[[^\]]*\]\s*$", "")

    def by_key(kind, rule):
        best = e.groupBy(kind(F.col("found")).alias("key")).agg(F.min("found").alias("found"))
        return w.withColumn("key", kind(F.col("wanted"))).join(best, "key").select("wanted", "found", F.lit(rule).alias("rule"))

    exact = w.join(e, w["wanted"] == e["found"]).select("wanted", "found", F.lit(0).alias("rule"))
    need = lambda c: F.greatest(F.lit(6), F.floor(F.lit(0.7) * F.length(c))).cast("int")
    prefix = lambda c, n: F.substring(c, F.lit(1), n)
    clean = lambda df, c: df.select(c, clean_stem(F.col(c)).alias("clean")).where("length(clean) >= 6").withColumn("size", F.length("clean"))
    a, b = clean(w, "wanted"), clean(e, "found")
    one = lambda df: df.withColumn("key", prefix(F.col("clean"), need(F.col("clean"))))
    every_prefix = lambda df: df.withColumn("key", F.explode(F.transform(F.sequence(F.lit(6), need(F.col("clean"))), lambda n: prefix(F.col("clean"), n))))
    # For each prefix the least directory of each length: a few rows, whatever the directories.
    lengths = lambda df: df.groupBy("key", "size").agg(F.min("found").alias("found")).groupBy("key").agg(F.collect_list(F.struct("size", "found")).alias("by_size"))
    best = lambda fits: F.array_min(F.transform(F.filter("by_size", fits), lambda x: x["found"])).alias("found")

    def met(rows, kept, fits):
        """Names with what they find, which depends on their key and length alone: looked up once for each of those. Keys of many names, of which there are few, go to the names; only the others are joined by key."""
        asked = rows.groupBy("key", "size").agg(F.count("*").alias("n")).join(kept, "key", "left").select("key", "size", "n", best(fits))
        asked = runtime.materialize(asked, "directories")
        many = F.broadcast(asked.where(F.col("n") > MANY).select("key", "size", "found", F.lit(True).alias("many")))
        told = rows.join(many, ["key", "size"], "left").where("many is null or found is not null")
        few = asked.where((F.col("n") <= MANY) & F.col("found").isNotNull()).select("key", "size", F.col("found").alias("other"))
        found = told.where("many").select("wanted", "found")
        return found if few.isEmpty() else found.unionByName(told.where("many is null").join(few, ["key", "size"]).select("wanted", F.col("other").alias("found")))

    shorter = met(one(a), lengths(every_prefix(b)), lambda x: x["size"] >= F.col("size"))
    longer = met(every_prefix(a), lengths(one(b)), lambda x: x["size"] < F.col("size"))
    near = shorter.unionByName(longer).where("found is not null").select("wanted", "found", F.lit(3).alias("rule"))
    every = exact.unionByName(by_key(tagless, 1)).unionByName(by_key(clean_stem, 2)).unionByName(near)
    return every.groupBy("wanted").agg(F.min(F.struct("rule", "found")).alias("m")).select("wanted", F.col("m.found").alias("found"), F.col("m.rule").alias("rule"))


def by_extension(names: DataFrame, files: DataFrame, order: list[str], name: str = "name", within: tuple[str, ...] = ()) -> DataFrame:
    """A file for each name: exact, else the same stem with the extension that comes first in ``order``; ``within`` names columns, such as the tenant, that must agree."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    ext = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1))
    n = names.select(*within, F.col(name).alias("wanted"))
    f = files.select(*within, F.col(name).alias("file"))
    rank = F.nullif(F.array_position(F.array(*map(F.lit, order)), ext), F.lit(0))
    match = lambda kind: n.withColumn("key", kind(F.col("wanted"))).join(f.withColumn("key", kind(F.col("file"))), [*within, "key"])
    exact = match(lambda c: c).select(*within, "wanted", F.struct(F.lit(0).cast("long").alias("rank"), F.col("file")).alias("m"))
    other = match(stem).select(*within, "wanted", F.struct(F.coalesce(rank, F.lit(1000)).cast("long").alias("rank"), F.col("file")).alias("m"))
    return exact.unionByName(other).groupBy(*within, "wanted").agg(F.min("m").alias("m")).select(*within, "wanted", F.col("m.file").alias("file"))


def listing(files: DataFrame, base: DataFrame) -> DataFrame:
    """Files with their hash and state in the ledger, in the order of their names without case."""
    known = base.select(F.col("filename").alias("name"), "md5", "status")
    return files.join(known, "name", "left").orderBy(F.lower("name"), "name")


def missing_files(names: DataFrame, staged: DataFrame, name: str = "name") -> DataFrame:
    """Names without a staged file: none of that name, and none whose name holds theirs or is held by it."""
    left = names.select(F.col(name).alias("wanted")).distinct()
    rest = runtime.materialize(left.join(staged.select(F.col(name).alias("wanted")), "wanted", "left_anti"), "names-rest")
    return rest.join(_contained(rest, staged.select(F.col(name).alias("found"))), "wanted", "left_anti")


def metadata_sync(documents: DataFrame, manifest: DataFrame, own: DataFrame, fields: DataFrame, names: list[str], size: int = 50) -> DataFrame:
    """Operations for documents(document_id, name) from the ledger(filename, chunks, ...), matched by stem or by the last part of ``chunks``, and from own metadata(filename, ...), which goes first; in batches of ``size`` by the order of document ids, numbered from 0 over all."""
    stem, last = F.regexp_replace("filename", r"\.[^.]*$", ""), F.regexp_replace("chunks", "^.*/", "")
    found = cascade(documents, manifest, [(F.col("name"), stem), (F.col("name"), last)], "document_id", "filename", "filename").select(F.col("left_key").alias("document_id"), F.col("right_key").alias("filename"))
    values = merged_metadata(found.join(manifest.select("filename", *names), "filename").drop("filename"), found.join(own.select("filename", *names), "filename").drop("filename"), "document_id", names)
    rows = numbered(metadata_operations(values, fields, "document_id", names), ["document_id"], "batch_no")
    return rows.withColumn("batch_no", F.floor(F.col("batch_no") / size).cast("int"))


#: Fixed: what a name is without, where names are compared.
NAME_MARKS = r"[\s\-_—（）()\[\]【】《》]"


#: Names that a part is looked up among by its first characters before it is sent: so many characters, and so many fronts at most.
FRONT, FRONTS = 4, 65_536


def contained_names(left: DataFrame, right: DataFrame, name: str = "name", often: int = 64, lengths: int = 8) -> DataFrame:
    """The least name of ``right`` for each left one that contains it or is contained by it, without case or marks; blank names match nothing.

    Names whose lengths lie between the same powers of two are a class. One of at most ``lengths`` lengths is looked up whole, in the parts of those
    lengths; only parts that begin like a name of their length are sent. Another is looked up by an inverted index of n-grams, n the power of two, so that one
    gram covers half of a name: by its rarest gram, then in full. A name whose rarest gram more than ``often`` names have is looked up whole too.
    So each way a name makes rows in proportion to its length, however many names share its parts.
    """
    return _contained(left.select(F.col(name).alias("wanted")).distinct(), right.select(F.col(name).alias("found")), often, lengths)


def _contained(left: DataFrame, right: DataFrame, often: int = 64, lengths: int = 8) -> DataFrame:
    """(wanted, found) for ``left(wanted)``, which are distinct, and ``right(found)``."""
    norm = lambda c: F.regexp_replace(F.lower(c), NAME_MARKS, "")
    a = runtime.materialize(left.select("wanted", norm(F.col("wanted")).alias("text")).where("text <> ''"), "names-left")
    b = runtime.materialize(right.select("found", norm(F.col("found")).alias("text")).where("text <> ''").groupBy("text").agg(F.min("found").alias("found")), "names-right")
    # The least name that holds a wanted one, and the least one that each wanted name holds.
    whole, few, held = _dealt(a.select("text"), b, often, lengths)
    rare = [held.join(few, "part").where("contains(text, asked)").select(F.col("asked").alias("text"), "found")] if few else []
    best = [_whole_parts(b, whole).select(F.col("part").alias("text"), "found"), *rare]
    best = best[0].unionByName(best[1]) if rare else best[0]
    up = a.join(best.groupBy("text").agg(F.min("found").alias("found")), "text").select("wanted", "found")

    whole, few, held = _dealt(b.select("text"), a, often, lengths)
    parts = _whole_parts(a, whole)
    # What is asked for is one row for each part; parts of many names go to those, so that no task has all of them.
    asked = runtime.materialize(parts.groupBy("part").agg(F.count("*").alias("n")).join(b, F.col("part") == b["text"]).select("part", "n", "found"), "names-asked")
    down = parts.join(F.broadcast(asked.where(F.col("n") > MANY).select("part", "found")), "part").select("wanted", "found")
    less = asked.where(F.col("n") <= MANY).select("part", "found")
    if not less.isEmpty():
        down = down.unionByName(parts.join(less, "part").select("wanted", "found"))
    if few:
        hit = held.join(few, "part").where("contains(text, asked)").select("wanted", F.col("asked").alias("text"))
        down = down.unionByName(hit.join(b, "text").select("wanted", "found"))
    return up.unionByName(down).groupBy("wanted").agg(F.min("found").alias("found"))


def _cut(n: Column) -> Column:
    """The parts of n characters of ``text``."""
    return F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))


def _parts(long: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows with each part of some lengths."""
    fits = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("text"))
    return long.select("*", F.explode(F.array_distinct(F.flatten(F.transform(fits, _cut)))).alias("part"))


def _whole_parts(long: DataFrame, short: DataFrame) -> DataFrame:
    """Rows of ``long`` with those parts that may be a text of ``short``: they have a length and, unless there are too many of those, a front of one."""
    front = lambda c: (F.length(c).alias("size"), F.substring(c, 1, FRONT).alias("front"))
    fronts = runtime.materialize(short.select(*front("text")).distinct(), "names-fronts")
    # One number for each length that occurs.
    parts = _parts(long, sorted(r[0] for r in fronts.select("size").distinct().collect()))
    if fronts.count() > FRONTS:
        return parts
    return parts.select("*", *front("part")).join(F.broadcast(fronts), ["size", "front"], "left_semi").drop("size", "front")


def _dealt(short: DataFrame, long: DataFrame, often: int, lengths: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The texts of ``short`` that are looked up whole; of the others, if there are any, (asked, part) with their rarest gram in ``long``, and the grams of ``long``."""
    classes: dict[int, list[int]] = {}
    # One number for each length that occurs.
    for r in short.select(F.length("text")).distinct().collect():
        classes.setdefault(r[0].bit_length(), []).append(r[0])
    whole = short.where(F.length("text").isin([n for c in classes.values() if len(c) <= lengths for n in c]))
    other = {k: c for k, c in classes.items() if len(c) > lengths}
    if not other:
        return whole, None, None
    grams = short.where(F.length("text").isin([n for c in other.values() for n in c])).distinct()
    held = _parts(long, [1 << k - 1 for k in other])
    common = held.groupBy("part").agg(F.count("*").alias("names"))
    asked = grams.select("text", F.explode(F.array_distinct(_cut(F.expr("shiftleft(1, length(bin(length(text))) - 1)")))).alias("part")).join(common, "part", "left")
    rarest = asked.groupBy("text").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "part")).alias("r")).select("text", "r.*").where("names > 0")
    rarest = runtime.materialize(rarest, "names-rarest")
    return whole.unionByName(rarest.where(F.col("names") > often).select("text")), rarest.where(F.col("names") <= often).select(F.col("text").alias("asked"), "part"), held


def similar_names(names: DataFrame, words: list[str], name: str = "name") -> DataFrame:
    """Pairs of names that share one of some keywords: an equi-join on the keyword, each pair once."""
    key = F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(name), w)))
    one = names.select(F.col(name).alias("a"), key.alias("word"))
    two = one.withColumnRenamed("a", "b")
    return one.join(two, "word").where("a < b").groupBy("a", "b").agg(F.min("word").alias("word"))


def shared_words(names: DataFrame, words: list[str], name: str = "name") -> DataFrame:
    """(word, names, first, last): the same groups without their pairs, whose number grows with the square of a group."""
    key = F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(name), w)))
    return names.select(F.col(name).alias("a"), key.alias("word")).distinct().groupBy("word").agg(F.count("*").alias("names"), F.min("a").alias("first"), F.max("a").alias("last"))


def merged_metadata(manifest: DataFrame, documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Values of two sources: a document's own, else the manifest's; blanks do not count."""
    value = lambda c: F.coalesce(F.nullif(F.btrim(F.col(f"d.{c}")), F.lit("")), F.nullif(F.btrim(F.col(f"m.{c}")), F.lit("")))
    return manifest.alias("m").join(documents.alias("d"), key, "full_outer").select(key, *(value(c).alias(c) for c in fields))


def metadata_operations(values: DataFrame, fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Operation lists: each value that is not blank with its field's id; a document without one has no row."""
    long = values.unpivot(key, names, "name", "value").where("value is not null and trim(value) <> ''")
    return long.join(fields, "name").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", F.col("field_id").alias("id"), "value"))).alias("operations"))


def batches(rows: DataFrame, order: list[str], size: int, group: str) -> DataFrame:
    """Batch numbers of ``size`` rows within each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place from 0 in the order of some columns, over all rows.

    Rows are dealt to ranges of the order; the sizes of the ranges (one row for each) are summed, and places within a range are
    counted by itself, so no one task numbers them all. Equal rows of the order are numbered in any way.
    """
    at, part = runtime.fresh("granary_at", rows), runtime.fresh("granary_part", rows)
    dealt = runtime.materialize(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(at))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn(name, within).join(before, part).withColumn(name, F.col(at) + F.col(name)).drop(part, at)


def next_numbers(base: DataFrame, fresh: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows not in the base, numbered on from its greatest number in the order of their keys."""
    new = fresh.join(base.select(key), key, "left_anti")
    top = base.agg(F.max(seq)).first()[0] or 0
    return numbered(new, [key], seq).withColumn(seq, F.lit(top) + F.col(seq) + 1)


def pipeline_status(outcomes: DataFrame, key: str) -> DataFrame:
    """ok, partial, failed or skipped over the enabled stages of a run."""
    on = F.col("enabled")
    n, bad = F.count_if(on), F.count_if(on & F.col("error").isNotNull())
    return outcomes.groupBy(key).agg(F.when(n == 0, "skipped").when(bad == 0, "ok").when(bad == n, "failed").otherwise("partial").alias("status"))


def retention(files: DataFrame, cutoff: Column) -> DataFrame:
    """Directories whose newest file is older than the cutoff, with what they hold."""
    return files.groupBy("top").agg(F.max("mtime").alias("newest"), F.sum("size").alias("bytes"), F.count("*").alias("files")).where(F.col("newest") < cutoff)


def changed_pages(current: DataFrame, ingested: DataFrame) -> DataFrame:
    """Pages with the hash that was ingested last, and whether it is the same."""
    last = latest(ingested, ["url"], ["id"]).select("url", F.col("content_hash").alias("prev_hash"))
    return current.join(last, "url", "left").withColumn("unchanged", F.coalesce(F.col("content_hash") == F.col("prev_hash"), F.lit(False)))


def stage_files(files: DataFrame, staged: DataFrame) -> DataFrame:
    """What staging does with each file: skipped if the same is there, renamed with part of its hash if another is, else staged."""
    s = staged.select(F.col("name").alias("there"), F.col("md5").alias("there_md5"))
    action = F.when(F.col("there").isNull(), "staged").when(F.col("md5") == F.col("there_md5"), "skipped").otherwise("renamed")
    target = F.when(action == "renamed", F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.substring("md5", 1, 6), F.regexp_extract("name", r"(\.[^.]*)$", 1))).otherwise(F.col("name"))
    return files.join(s, files["name"] == s["there"], "left").select(*files.columns, action.alias("action"), target.alias("target"))


def scan_actions(files: DataFrame, manifest: DataFrame, extensions: list[str]) -> DataFrame:
    """Files against the ledger: NEW, KNOWN or MISSING."""
    f = files.where(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(extensions)).select(F.col("name"), F.lit(True).alias("on_disk"))
    m = manifest.select(F.col("filename").alias("name"), F.lit(True).alias("in_ledger"))
    return f.join(m, "name", "full_outer").select("name", F.when(F.col("in_ledger").isNull(), "NEW").when(F.col("on_disk").isNull(), "MISSING").otherwise("KNOWN").alias("action"))


def report_by_stem(actions: DataFrame, stems: DataFrame) -> DataFrame:
    """The first record of each wanted stem and stage, and the stem's status."""
    first = actions.groupBy("stem", "stage").agg(F.min_by(F.struct("action", "failed"), "ord").alias("r"))
    return stems.join(first, "stem", "left").groupBy("stem").agg(F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("stage", F.col("r.action").alias("action"))))).alias("stages"), F.when(F.max(F.col("r.failed")), "partial").when(F.count("stage") == 0, "none").otherwise("ok").alias("status"))


def unique_names(names: DataFrame, group: list[str], name: str, url: str) -> DataFrame:
    """Names made unique in their group: all but the first get part of their address's hash."""
    w = Window.partitionBy(*group, name).orderBy(url)
    n = F.row_number().over(w)
    return names.withColumn("granary_n", n).withColumn("unique_name", F.when(F.col("granary_n") == 1, F.col(name)).otherwise(F.concat(F.substring(name, 1, 40), F.lit("__"), F.substring(F.sha1(url), 1, 6)))).drop("granary_n")


def verify_key(keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Tenants of the keys presented: only the hash is stored; an inactive tenant or an unknown key has none; no key is the default tenant."""
    t = tenants.where("status = 'active'").select("tenant_id", "api_key_hash")
    hashed = keys.withColumn("api_key_hash", F.sha2("api_key", 256))
    return hashed.join(t, "api_key_hash", "left").select(*keys.columns, F.when(F.col("api_key").isNull(), "default").otherwise(F.col("tenant_id")).alias("tenant_id"))


def keyword_rows(rows: DataFrame, keyword: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the keyword, without case; no keyword keeps all."""
    if not keyword.strip():
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(keyword.strip().lower()))
    return rows.where(hit)


def list_segments(segments: DataFrame, order: list[str], keyword: str = "", status: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of segments by keyword and status, in their order."""
    rows = keyword_rows(segments, keyword, ["content"])
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(*order).offset(max(0, page - 1) * limit).limit(limit)


def not_persisted(created: DataFrame, current: DataFrame, key: str = "segment_id") -> DataFrame:
    """What was created and is not there any more."""
    return created.join(current.select(key), key, "left_anti")


def landing(items: DataFrame, confirmed: DataFrame, known: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Confirmed items of a crawl and what becomes of them: failed, unchanged, or landed. Items are told apart by ``keys``, their URL if there are none."""
    keys = keys or ["url"]
    last = latest(known, keys, ["id"]).select(*keys, F.col("content_hash").alias("prev_hash"))
    rows = items.join(confirmed.select(*keys).distinct(), keys, "left_semi").join(last, keys, "left")
    return rows.withColumn("action", F.when(~F.col("ok"), "FAILED").when(F.col("content_hash") == F.col("prev_hash"), "UNCHANGED").otherwise("LANDED")).drop("prev_hash")


def record_status(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Crawl records with their state in the ledger: error before ingested before parsed before landed."""
    m = manifest.select("stem", F.col("status").alias("ledger_status"), F.col("remote_id"), F.col("parse"))
    state = F.when(F.col("ledger_status") == "error", "error").when(F.length(F.coalesce("remote_id", F.lit(""))) > 0, "ingested").when(F.length(F.coalesce("parse", F.lit(""))) > 0, "parsed").when(F.col("ledger_status").isNotNull(), "landed").otherwise(F.col("status"))
    return records.join(m, "stem", "left").withColumn("status", state).drop("ledger_status", "remote_id", "parse")


def listed_directories(chunks: DataFrame, output: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Directories of two listings, each path once, of the wanted stems if they are named."""
    rows = chunks.unionByName(output).dropDuplicates(["path"])
    return rows if wanted is None else rows.join(wanted.select("stem").distinct(), "stem", "left_semi")


# --- tenants, reuse of documents, staging of output -------------------------------------------------

TENANT_ID = "^[a-z0-9][a-z0-9_-]{0,62}$"


def created_tenants(tenants: DataFrame, wanted: DataFrame, now: str) -> DataFrame:
    """What becomes of each wanted tenant(tenant_id, name, dataset_id, api_key): the row to add with the key's hash, or why there is none in ``denied``."""
    id_ = F.lower(F.btrim("tenant_id"))
    there = tenants.select(F.col("tenant_id").alias("there"))
    rows = wanted.withColumn("tenant_id", id_).join(there, F.col("tenant_id") == F.col("there"), "left")
    denied = F.when(~F.col("tenant_id").rlike(TENANT_ID), "malformed").when(F.col("tenant_id") == "default", "built in").when(F.length(F.btrim(F.coalesce("dataset_id", F.lit("")))) == 0, "no dataset").when(F.col("there").isNotNull(), "exists")
    return rows.select("tenant_id", "name", F.btrim("dataset_id").alias("dataset_id"), F.sha2("api_key", 256).alias("api_key_hash"), F.lit("active").alias("status"), F.lit(now).alias("create_time"), F.lit(now).alias("update_time"), denied.alias("denied"))


def updated_tenants(tenants: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Tenants with the values of ``changes(tenant_id, name, dataset_id, status, api_key)`` that are not null; a new key replaces the old one at once."""
    c = changes.select("tenant_id", *(F.col(x).alias(f"new_{x}") for x in ("name", "dataset_id", "status")), F.sha2("api_key", 256).alias("new_api_key_hash"))
    fields = ("name", "dataset_id", "status", "api_key_hash")
    touched = F.coalesce(*(F.col(f"new_{f}") for f in fields)).isNotNull()
    rows = tenants.join(c, "tenant_id", "left").withColumn("update_time", F.when(touched, now).otherwise(F.col("update_time")))
    return rows.select(*((F.coalesce(f"new_{x}", x).alias(x) if x in fields else F.col(x)) for x in tenants.columns))


def removed_tenants(tenants: DataFrame, ids: DataFrame) -> DataFrame:
    """Tenants without those named; the default tenant stays."""
    return tenants.join(ids.where("tenant_id <> 'default'").select("tenant_id").distinct(), "tenant_id", "left_anti")


def reused_documents(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """wanted(name) against documents(document_id, name, indexing_status, ord): CREATE, or REUSE the first of that name; CLEAR tells whether its segments go first."""
    first = documents.groupBy("name").agg(F.min_by(F.struct("document_id", "indexing_status"), "ord").alias("d"))
    rows = wanted.join(first, "name", "left")
    return rows.select(*wanted.columns, F.col("d.document_id").alias("document_id"), F.when(F.col("d").isNull(), "CREATE").otherwise("REUSE").alias("action"), F.coalesce(F.col("d.indexing_status") == "completed", F.lit(False)).alias("clear"))


def cleared_segments(segments: DataFrame, reused: DataFrame) -> DataFrame:
    """Segments without those of documents that are reused and cleared."""
    return segments.join(reused.where("clear").select("document_id").distinct(), "document_id", "left_anti")


def staged_output(chunks: DataFrame, output: DataFrame) -> DataFrame:
    """chunks(tenant_id, stem, root) before an upload: whether a copy goes to the output folder. What is there already, or does not come from the chunk folder, is not copied."""
    there = output.select("tenant_id", "stem", F.lit(True).alias("there")).distinct()
    rows = chunks.join(there, ["tenant_id", "stem"], "left")
    return rows.withColumn("copied", (F.col("root") == "chunks") & F.col("there").isNull()).drop("there")


def cleaned_output(staged: DataFrame, results: DataFrame) -> DataFrame:
    """After the upload, results(tenant_id, stem, ok): where a copied document's folder stays, and which one is deleted."""
    rows = staged.join(results, ["tenant_id", "stem"], "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    home = F.when(F.col("copied") & ok, "output").otherwise(F.col("root"))
    return rows.select(*staged.columns, F.concat_ws("/", home, "stem").alias("chunks"), F.when(F.col("copied") & ok, F.concat_ws("/", "root", "stem")).when(F.col("copied"), F.concat(F.lit("output/"), "stem")).alias("deleted"))


def crawl_groups(items: DataFrame) -> DataFrame:
    """Confirmed items of a crawl by (profile_id, dataset_id), and those that cannot go in with the reason: url, profile_id, dataset_id, group_size, denied."""
    denied = (
        F.when(~F.coalesce(F.col("ok"), F.lit(False)), "not fetched").when(~F.coalesce(F.col("confirmed"), F.lit(False)) | (F.coalesce("stem", F.lit("")) == ""), "not confirmed")
        .when(F.col("ingest_status") == "ok", "already in").when((F.coalesce("profile_id", F.lit("")) == "") | (F.coalesce("dataset_id", F.lit("")) == ""), "no target")
    )
    rows = items.select("url", "profile_id", "dataset_id", denied.alias("denied"))
    sizes = rows.where("denied is null").groupBy("profile_id", "dataset_id").agg(F.count("*").alias("group_size"))
    return rows.join(sizes, ["profile_id", "dataset_id"], "left").select("url", "profile_id", "dataset_id", F.when(F.col("denied").isNull(), F.col("group_size")).alias("group_size"), "denied")
