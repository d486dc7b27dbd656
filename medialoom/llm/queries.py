"""The corpus operators as registered queries, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.llm import bpe, dac, dialogue, mixing, neardup, oracles, pii, quality, repeats, resample, secrets, shards, tokencount, topk
from medialoom.llm.common import spread
from medialoom.session import table


def op1_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op2_mixing(spark, sf_dir):
    out = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    told = [F.get(c, F.lit(k)).alias(f"{c}_{name}") for c in ("targets", "reached") for k, name in enumerate(mixing.DOMAINS)]
    return out.select("doc_id", "n_tokens", *shares, "rate", "copies", *told, "missed", "growth_wanted", "growth_taken", "largest_rate")


def op3_substring_dedup(spark, sf_dir):
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op4_bpe(spark, sf_dir):
    enc = bpe.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "word_bpe_49k.json")
    return enc.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_pii(spark, sf_dir):
    df = pii.find(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("spans", lambda s: s["rank"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_minhash_neardup(spark, sf_dir):
    return neardup.components(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_token_files(spark, sf_dir):
    back = dac.stored(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_secret_scan(spark, sf_dir):
    df = secrets.find(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op9_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_quality_rules(spark, sf_dir):
    return quality.quality_report(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_uniform_shards(spark, sf_dir):
    return shards.report(table(spark, sf_dir, "documents"), shards=8)


def op12_conversation_repair(spark, sf_dir):
    return dialogue.report(table(spark, sf_dir, "conversations"), damage=True)


def op13_importance_resampling(spark, sf_dir):
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def queries():
    return {
        "op1_token_counts": op1_token_counts,
        "op2_mixing": op2_mixing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_bpe": op4_bpe,
        "op5_pii": op5_pii,
        "op6_minhash_neardup": op6_minhash_neardup,
        "op7_token_files": op7_token_files,
        "op8_secret_scan": op8_secret_scan,
        "op9_topk": op9_topk,
        "op10_quality_rules": op10_quality_rules,
        "op11_uniform_shards": op11_uniform_shards,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql():
    return {
        "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op6_minhash_neardup": oracles.NEAR_DEDUP,
        "op9_topk": oracles.TOPK,
        "op10_quality_rules": oracles.QUALITY,
        "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
        "op13_importance_resampling": oracles.IMPORTANCE_RESAMPLING,
    }
