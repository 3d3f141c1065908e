"""From raw documents to training tokens: language, near copies, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of documents.
Columns beyond those of documents are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import language, mixing, secret_scan, simhash, unigram
from barloom.llm.shared import discard, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language has to explain a text better than all others together, and not worse than this many deviations below what is usual for
#: the texts that it was learned from (set on labelled documents, the worst of which is at -7.1; unlabelled languages are at -8 to -22).
LEAST_POSTERIOR, LEAST_FIT = 0.5, -7.5
#: Near copies: five-word shingles, 384 bits, of which at a similarity of 0.8 some 58 differ, and 192 between other texts.
NEAR = simhash.Scheme.wide(shingle=5, words=6, radius=72)
#: Shares of domains and languages in nine tenths of all tokens; no document twice.
MIX = mixing.Mix(weights={"domain": {"web": 5, "books": 3, "code": 3}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}}, budget=(9, 10), epochs=1)
DOMAIN = "case when right(source, 1) in ('0', '1', '2', '3') then 'web' when right(source, 1) in ('4', '5', '6') then 'books' else 'code' end"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; a missing label is filled in. Out go texts that are null or without a
    letter, those that no language explains better than all others together, and those that fit the best one far worse than
    what it was learned from, as texts in an unlabelled language do. Without any label, nothing can be told and every document
    with a letter stays.
    """
    docs = docs.select(*COLUMNS)
    model = language.learn(docs)
    found = language.identify(docs, model)
    if not model.langs:
        return found.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    fits = F.coalesce(F.col("language.fit") >= LEAST_FIT, F.lit(True))
    return found.where((F.col("language.lang_pred") != language.UNKNOWN) & (F.col("language.score") >= LEAST_POSTERIOR) & fits).withColumn("lang", F.coalesce("lang", "language.lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that with the smallest id, any one of those that share it; a row without an id
    only where the group has no other. Rows are told apart by themselves, not by their ids.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "numbered")
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("_key"), "text")
    found = simhash.near_duplicates(keyed, "_key", scheme=NEAR)
    leaders = written(found.where("_key = component").select("_key._row"), "leaders")
    return rows.join(leaders, "_row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars set anew where a text has changed."""
    masked = docs.select(*COLUMNS).withColumn("masked", secret_scan.redacted(F.col("text")))
    n = F.when(F.col("masked").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("masked").cast(docs.schema["n_chars"].dataType))
    return masked.select("doc_id", F.col("masked").alias("text"), "lang", "source", n.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget. The one at the cut keeps its first tokens, joined by single spaces."""
    docs = docs.select(*COLUMNS).withColumn("domain", F.expr(DOMAIN))
    cuts = mixing.cuts(written(mixing.counted(docs, MIX), "tokens"), MIX)
    level = lambda c: F.coalesce(F.col(c), F.lit(mixing.NONE))
    rows = docs.withColumns({"own_lang": F.col("lang"), "own_source": F.col("source"), "id": F.col("doc_id"), "n_tokens": F.coalesce(F.regexp_count("text", F.lit(mixing.TOKENS)), F.lit(0)).cast("long")})
    rows = rows.withColumns({c: level(c) for c in MIX.levels})
    taken = mixing.taken(rows, cuts, MIX).where("tokens_taken > 0")
    part = F.col("tokens_taken") < F.col("n_tokens")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.TOKENS), F.lit(0)), 1, F.col("tokens_taken").cast("int")), " ")
    text = F.when(part, first).otherwise(F.col("text"))
    return taken.select("doc_id", text.alias("text"), F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), F.when(part, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, piece_ids) of each document."""
    return unigram.tokenized(docs.select(*COLUMNS)).select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language", languages), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("pieces", pieces)]

#: SQL has no forward sums over segmentations, SimHash or Viterbi; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written down for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            discard(before)
    return docs
