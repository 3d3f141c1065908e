"""The numbered queries: each operator over its whole table with production parameters, in the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, language, lexical, mixing, oracles, ppm, quality_rules, secret_scan, simhash, suffix_dedup, topk, unigram, variants, warc
from .shared import held_out, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*(b[0] for b in secret_scan.BASE)))
    return docs.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secret_spans")).alias("spans"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    model = language.learn(docs.where("not held_out"))
    return language.identify(docs, model).select("doc_id", "held_out", "language.lang_pred", "language.score")


#: What the query mixes: shares of domains and languages, all sources of a language alike; each document up to four times.
MIX = mixing.Mix(weights={"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 1}}, budget=(1, 1), epochs=4)
DOMAIN = "case when right(source, 1) in ('0', '1', '2', '3') then 'web' when right(source, 1) in ('4', '5', '6') then 'books' else 'code' end"


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", F.expr(DOMAIN))
    return mixing.mixed(docs, MIX)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    archives = written(warc.write_archives(warc.with_revisits(pages)), "archives")
    number = lambda c: F.col(c).cast(kind).alias(c)
    return warc.read_archives(archives).select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "problem")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm.score(docs, ~held_out("doc_id", 7)).select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", unigram.round_trip("text").alias("coded"))
    return docs.select("doc_id", F.size("coded.piece_ids").cast("long").alias("n_pieces"), "coded.round_trip", "coded.piece_ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality_rules.judged(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", *quality_rules.COUNTS, F.col("failed").alias("base_failed"), (~F.col("failed") & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_language, op3_mixing, op4_warc, op5_topk, op6_ppm, op7_sentencepiece, op8_quality_rules, op9_simhash, op10_suffix_dedup, op11_jaccard, op12_variants, op13_search)}

#: The other operators use hashes, models or byte positions that SQL lacks; tests hold their queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": oracles.mixing_sql(MIX.weights, MIX.levels, DOMAIN, MIX.budget, MIX.epochs, MIX.seed),
    "op4_warc": oracles.WARC_SQL,
    "op5_topk": oracles.TOPK_SQL,
    "op11_jaccard": oracles.JACCARD_SQL,
    "op13_search": oracles.SEARCH_SQL,
}
