"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chat, decontam, dedup, langid, lm, media, packing, pii, quality, sharding


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = langid.fold("doc_id", 7) == 2
    model = lm.train(docs.where(~held))
    out = lm.score(docs, model, [F.col("doc_id"), held.alias("held_out")])
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = langid.fold("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    return langid.identify(docs, model, [F.col("doc_id"), held.alias("held_out")])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_documents(spark, sf_dir), sharding.tree(40), sharding.tree(41))
    return out.withColumn("law", F.lit("key"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_documents(spark, sf_dir), [F.col("doc_id")])
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), with_ids=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
with dw as (
  select doc_id, row_number() over () rid, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
bw as (
  select item_id, row_number() over () iid, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from benchmark),
ks as (select distinct least(len(w), 5) k from bw where len(w) > 0),
ds as (
  select distinct doc_id, rid, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) s from dw, ks where len(w) >= k),
bs as (
  select distinct item_id, iid, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) s from bw where len(w) > 0),
n as (select iid, count(*) n from bs group by iid),
p as (select doc_id, rid, item_id, bs.iid, count(*) n_shared from ds join bs using (s) group by doc_id, rid, item_id, bs.iid),
q as (select doc_id, item_id, n n_item, n_shared, row_number() over (partition by doc_id, item_id order by n_shared / n desc, n desc) k
      from p join n using (iid) where n_shared * 100 >= n * 75)
select doc_id, item_id, n_item, n_shared, cast(n_shared as double) / n_item containment from q where k = 1
"""


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_columns(_documents(spark, sf_dir))
    return m.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.size("fingerprint").alias("n_pairs"),
        F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256).alias("feature"),
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.END}{chat.START}assistant ok"
    own = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    more = chat.canonical_turns(spark.createDataFrame([(-1, own)], "conv_id long, record string"), "record")
    turns = chat.canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.format_turns(turns.unionByName(more)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(_documents(spark, sf_dir), labels.where("quality = 1 and toxic = 0").select("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_near_dedup, op4_sharding, op5_pii, op6_packing, op7_decontamination, op8_media_columns, op9_chat_formatting, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": OP7_SQL}
