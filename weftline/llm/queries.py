"""The queries of the training-data operators: thin digests of what the operators give, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id, lm_score, media, mixing, pii, quality_rules, sharding, simhash, suffix_dedup
from .common import bounded_batches

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN).drop("round_trip")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"),
    )


#: Targets as the contract words them: shares by weight, cut at twice a source's size, and what is cut off shared again
#: among the sources that are not cut, until none is above.
OP3_SQL = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight,
             greatest(16, ceil(sum(n) over () / 262144.0))::bigint as salts from s),
shares as (
  select 0 as round, source, weight, source_size, false as cut, 150 * sum(source_size) over ()::bigint as words, (150 * sum(source_size) over ())::double / (100 * sum(weight) over ())::double * weight as share from w
  union all
  select round + 1, source, weight, source_size, over_, words,
         case when over_ then 2.0::double * source_size
              else (words - 200 * sum(case when over_ then source_size else 0 end) over ())::double / (100 * sum(case when over_ then 0 else weight end) over ())::double * weight end
  from (select *, cut or share > 2 * source_size as over_, max(case when not cut and share > 2 * source_size then 1 else 0 end) over () as more from shares) x where more = 1
),
t as (select w.*, x.share as target, (('0x' || substr(md5(coalesce('source:' || w.source, 'none')), 1, 8))::bigint % 1024 + 0.5::double) / 1024 as off
      from w join (select * from shares qualify round = max(round) over ()) x on w.source is not distinct from x.source),
r as (select d.doc_id, d.size, t.source_size, t.target, t.off, case when t.source_size > 0 then t.target / t.source_size else 0 end as each,
             row_number() over (partition by d.source order by
               case when size < 8 then size else length(bin(size)) * 8 + (size // (2 ** greatest(0, length(bin(size)) - 4))::bigint) % 8 end,
               d.h % t.salts, size, d.h, doc_id nulls first) - 1 as pos
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (least(2, floor((pos + 1) * each + off) - floor(pos * each + off)) * size)::bigint as taken from r
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(documents(spark, sf_dir), parts=4, held=2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(documents(spark, sf_dir), words_each=3)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.remainder(F.col("doc_id"), 5) == 1
    return lm_score.scores(documents(spark, sf_dir), held_out, RANKS, public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_byte_bpe, op3_mixing, op4_sharding, op5_language_id, op6_simhash, op7_media, op8_lm_score, op9_suffix_dedup, op10_pii)
}
SQL = {"op3_mixing": OP3_SQL}
