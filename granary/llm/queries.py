"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import runtime
from granary.llm import counts, curriculum, decontam, divergence, langid, licenses, packing, quality, rans, simhash, spelling, tokens, topk, unitdedup

#: A row without an id is never held out.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = runtime.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return runtime.spread(df) if name == "documents" else df


def vocabulary() -> str:
    return tokens.definition(public_tokenizers.path("byte_bpe_50k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary(), size=1024, end_id=0))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitdedup.repeats(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rans.read(spark, rans.write(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.attribute(table(spark, sf_dir, "documents"), vocabulary())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(f"not ({HELD_OUT})").select("doc_id", "quality")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(f"not ({HELD_OUT})")))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "languages")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", curriculum.words().alias("size"), key.alias("key"))
    mixed = curriculum.mix(docs, key=F.col("key"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), F.size("positions").alias("visits"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""


OP11_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    md5(coalesce(cast(doc_id as varchar), text, '')) as key from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (
  select *, [3, 1, 2][(k - 1) % 3 + 1] as weight, sum(source_size) over () * 1.5 as total, 2 * source_size as cap from s),
l as (
  select *, sum(weight) over (order by cap / weight, k rows between current row and unbounded following) as rest,
    coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0) as used from w),
c as (select *, cap * rest <= (total - used) * weight as stopped from l),
t as (
  select *, case when stopped then cast(cap as double) else cast(total - coalesce(sum(cap) filter (where stopped) over (), 0) as double) * weight / sum(weight) filter (where not stopped) over () end as target from c),
p as (
  select d.doc_id, d.size, d.source, t.source_size, t.target, t.weight, least(cast(floor(t.target + 0.5) as bigint), t.cap) as goal,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.size desc rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source),
v as (
  select *, cast(greatest(least(goal - before, size), 0) as bigint) as one, cast(greatest(least(goal - source_size - before, size), 0) as bigint) as two from p),
m as (select *, weight * ((before + one / 2) / goal) as part from v)
select doc_id, cast(size as bigint) as size, source_size, target, one + two as taken, cast((case when one > 0 then 1 else 0 end) + (case when two > 0 then 1 else 0 end) as integer) as visits,
  round(case when one = 0 then null when weight = 1 then sqrt(part) when weight = 2 then part / 2 when part <= 2 then part / 4
    else 0.5 + 2 * (part - 2) / (4 + sqrt(greatest(16 - 16 * (part - 2), 0))) end, 9) as position
from m
"""


OP13_SQL = """
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
o as (select lang, source, r, unnest(terms) as term from d),
k as (select lang, term from o group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*) as V from k group by lang),
c as (select o.lang, o.source, o.term, count(*) as n from o join k on o.lang = k.lang and o.term = k.term group by o.lang, o.source, o.term),
g as (select distinct lang, source from d),
x as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k on g.lang = k.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (
  select x.lang, x.source, x.term, x.n,
    1 + (cast(1000000000 as hugeint) * (n + 2)) // (sum(n) over (partition by x.lang, x.source) + 2 * V) as p,
    1 + (cast(1000000000 as hugeint) * (sum(n) over (partition by x.lang, x.term) + 2)) // (sum(n) over (partition by x.lang) + 2 * V) as q
  from x join v on x.lang = v.lang),
f as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q),
z as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from z where part = 'pair' or rank <= 10
"""


def queries() -> dict:
    found = (op1_packing, op2_substring_dedup, op3_decontamination, op4_simhash, op5_token_files, op6_token_counts, op7_license_scan, op8_quality, op9_topk, op10_language, op11_mixing, op12_spelling, op13_divergence)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_topk": OP9_SQL, "op11_mixing": OP11_SQL, "op13_divergence": OP13_SQL}
