"""The thin queries over the operators, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, license_scan, near_dedup, packing, pii, shard, topk, toxicity, warc
from ._session import held_out, learnable

BASE_KINDS = ("email", "ip", "card", "phone")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), learnable())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [count(kind) for kind in BASE_KINDS]
    scores = F.transform("spans", lambda s: s["score"]).alias("scores")
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard.assign(_read(spark, sf_dir, "documents"), n_shards=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.train(docs, learnable()))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first_word"])
    return got.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(_read(spark, sf_dir, "pages"), least_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_near_dedup, op3_toxicity, op4_pii, op5_sharding, op6_language_id, op7_license_scan, op8_warc, op9_topk, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": shard.oracle_sql(8), "op8_warc": warc.oracle_sql(0), "op9_topk": topk.oracle_sql(20, 20)}
