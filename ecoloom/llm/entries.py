"""The registered queries opN_<name>, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ecoloom.llm import decontamination, fingerprints, langid, lm, mixing, neardup, pii, quality, toxicity, warc
from ecoloom.llm.common import stored


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(_read(spark, sf_dir, "documents"), percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = mixing.in_order(mixing.mix(_read(spark, sf_dir, "documents")))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(_read(spark, sf_dir, "documents"), key="ecoloom-pseudonyms")
    return done.select("doc_id", "text", "n_private")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(fingerprints.edited_neighbours(_read(spark, sf_dir, "documents")), "fingerprints")
    return fingerprints.with_matches(rows)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_language,
        op3_neardup,
        op4_decontamination,
        op5_warc,
        op6_mixing,
        op7_pii,
        op8_lm,
        op9_fingerprints,
        op10_quality,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
w as (select *, [3.0, 1.0, 2.0][(rank % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap from r),
o as (select *, cap / weight as ratio from w),
l as (select *,
        (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0.0::double))
        / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0.0::double)) as level
      from o),
h as (select arg_min(level, rn) as held from (select level, row_number() over (order by ratio, rank) as rn from l where level < ratio)),
t as (
  select source, source_size, case when held is null then cap else least(cap, held * weight) end as target,
         [1.5, 1.0, 0.5][(rank % 3 + 1)::int]::double as weight_from, [0.5, 1.0, 1.5][(rank % 3 + 1)::int]::double as weight_to
  from l, h),
c as (
  select d.*, t.source_size, t.target, weight_from, (weight_to - weight_from) / 2 as half,
         coalesce(sum(size) over (partition by d.source order by digest, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start_at
  from d join t on d.source is not distinct from t.source),
w1 as (select *, greatest(0, least(size, floor(target)::bigint - start_at)) as one, greatest(0, least(size, floor(target)::bigint - start_at - source_size)) as two from c),
s1 as (select *, start_at / greatest(1.0::double, target) as share_1, (start_at + source_size) / greatest(1.0::double, target) as share_2 from w1),
a1 as (select *, share_1 * (weight_from + half) as area_1, share_2 * (weight_from + half) as area_2 from s1)
select doc_id, size, source_size, target, (one + two)::bigint as taken,
       case when one = 0 then null when share_1 <= 0 then 0.0 when share_1 >= 1 then 1.0 when abs(half) < 1e-12 then share_1
            else 2 * area_1 / (weight_from + sqrt(greatest(0.0, weight_from * weight_from + 4 * half * area_1))) end as position,
       case when two = 0 then null when share_2 <= 0 then 0.0 when share_2 >= 1 then 1.0 when abs(half) < 1e-12 then share_2
            else 2 * area_2 / (weight_from + sqrt(greatest(0.0, weight_from * weight_from + 4 * half * area_2))) end as position_again
from a1
""",
    "op4_decontamination": r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w
  from documents),
i as (
  select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w
  from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') as k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) as p from i where len(w) > 0)),
lens as (select distinct n from win),
dw as (
  select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n)),
hits as (select dw.doc_id, dw.p, dw.n, win.item_id from dw join win on dw.k = win.k and dw.n = win.n),
pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(pos.n_hit, 0)::bigint as n_hit, coalesce(its.n_items, 0)::bigint as n_items,
       sha256(coalesce(its.ids, '')) as items_sha256, coalesce(pos.n_hit, 0) > 0 as contaminated
from d left join pos on d.doc_id = pos.doc_id left join its on d.doc_id = its.doc_id
""",
}
