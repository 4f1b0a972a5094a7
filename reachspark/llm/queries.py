"""Registered queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachspark.llm import filter_audit, fuzzy_lines, importance, jaccard, licences, lm_scoring, mixing, prefix_trie, quality_rules, sharding, templates, token_files, warc
from reachspark.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words as SQL expressions over ``text``.
_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL text if SQL can express it."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}"


@query()
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer_path(), path)
    return token_files.digest(token_files.read_token_files(spark, path))


@query()
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    rf"""
with d as (
  select doc_id, source, len({_WORDS_SQL})::bigint as size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source nulls last) as turn from d group by source),
w as (
  select *, [5.0, 2.0, 1.0][((turn - 1) % 3 + 1)::int]::double as weight, 3.0::double * source_size as cap,
         sum(source_size) over ()::double as total from s),
r as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
g as (select (select level from r where level <= cap / weight order by cap / weight, source nulls last limit 1) as found, * from r),
t as (select source, source_size, case when found is null then cap else least(cap, weight * found) end as target from g),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as rounds from t),
c as (
  select d.*, p.source_size, p.target, p.rounds, p.target - p.rounds * p.source_size as wanted,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row)::double as upto,
         sum(d.size) over (partition by d.source, d.h)::double as tied
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target,
       size * (rounds + case when upto <= wanted or (upto - tied <= wanted and upto - wanted < wanted - (upto - tied)) then 1 else 0 end)::bigint as taken
from c"""
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), (5, 2, 1), 3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "stop_words", "n_upper", "n_lines",
    )


@query()
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), 3, 90, 100)


@query()
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query()
def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(read(spark, sf_dir, "pages")))
    return found.select(
        F.substring("record_id", 2, 20).cast("long").alias("page_id"), "target_uri", "date", "prior", "verdict",
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("head")))).alias("head"), F.crc32("payload").alias("payload_crc32"),
    )


@query()
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", "source", "lang", block, F.col("doc_id").cast("string"))
    found = licences.scan_licences(docs.select(path.alias("path"), "text"))
    doc_id = F.substring_index("path", "/", -1).cast("long").alias("doc_id")
    return found.select(
        doc_id, "path", "notice", F.round("cosine", 6).alias("cosine"), "n_notices", "file_licence", "licence", "via", "from_dir"
    )


@query(
    rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_WORDS_SQL} as ws from documents),
m as (
  select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic
  from labels group by doc_id),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         16 * (len(ws) < 200)::int + 8 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
         + 2 * regexp_matches(t, '[#$%&*|]')::int
         + coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as mask
  from d left join m on d.doc_id = m.doc_id),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, mask),
l as (select unnest(range(5)) as i),
o as (
  select [a.i, b.i, c.i, d.i, e.i] as ord from l a, l b, l c, l d, l e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (
  select list_reduce(list_transform(ord, lambda x: substr('ABCDE', (x + 1)::int, 1)), lambda x, y: x || y) as filter_order, step,
         (16 >> ord[step]::int)::bigint as bit,
         coalesce(list_sum(list_transform(ord[1:step - 1], lambda x: 16 >> x::int)), 0)::bigint as earlier
  from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (
  select part, filter_order, step, bit,
         sum(case when mask & (earlier | bit) = 0 then n else 0 end)::bigint as kept,
         sum(case when mask & earlier = 0 and mask & bit <> 0 then n else 0 end)::bigint as removed,
         sum(case when mask & earlier <> 0 and mask & bit <> 0 then n else 0 end)::bigint as redundant,
         sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
         sum(case when mask & earlier = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
         sum(case when mask & earlier = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley
from r"""
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(read(spark, sf_dir, "documents"))


@query()
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
