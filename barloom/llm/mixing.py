"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, and token-prefixes of seeded epochs.

DataFrame functions only. Whatever the number of documents, no task sees a whole leaf: a leaf's place of the cut is found by
summing tokens in 256 parts of the hash range, then in 256 parts of the part that holds the cut, and only the documents of
that last part are put in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

NONE = "(none)"
TOKENS = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights: by level, by value; a value that is not listed has weight 1, and weight 0 keeps it out.

    budget: the tokens to hand out, as a share (numerator, denominator) of all tokens there are.
    epochs: how often a document can be taken at most. seed: of the epochs' orders.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget: tuple[int, int] = (1, 1)
    epochs: int = 4
    seed: int = 42

    def weight(self, level: str) -> Column:
        named = self.weights.get(level, {})
        out = F.lit(1)
        for value, w in sorted(named.items()):
            out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
        return out.cast("long")


def counted(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, levels, n_tokens) of each row. Null levels count as (none), a null text as one without tokens."""
    return docs.select(F.col(id).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in mix.levels], F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long").alias("n_tokens"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(levels, supply, budget) of each leaf of (levels, supply).

    Down from the root, each node's budget goes to its children by weight. A child that cannot use its share, for want of
    tokens below it, is filled, and what it leaves goes to its siblings by weight; as no node ever gets more than there is
    below it, a shortage reaches its ancestors' siblings only after its own. Shares are rounded down to whole tokens.
    """
    long = lambda c: F.col(c).cast("decimal(20,0)")
    parents = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("_all")).select(F.lit(0).alias("_root"), F.expr(f"least(_all * {mix.epochs}, (_all * {mix.budget[0]}) div {mix.budget[1]})").alias("budget"))
    for depth, level in enumerate(mix.levels, 1):
        above, own = ["_root", *mix.levels[: depth - 1]], ["_root", *mix.levels[:depth]]
        nodes = leaves.withColumn("_root", F.lit(0)).groupBy(*own).agg((F.sum("supply") * mix.epochs).alias("cap")).withColumn("w", mix.weight(level)).where("w > 0")
        siblings = Window.partitionBy(*above)
        by_fill = siblings.orderBy(F.col("cap").cast("double") / F.col("w"), level)
        nodes = (
            nodes.join(parents.withColumnRenamed("budget", "_b"), above)
            .withColumn("_c", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_w", F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("_full", long("cap") * F.col("_w").cast("decimal(17,0)") <= (long("_b") - long("_c")) * F.col("w").cast("decimal(16,0)"))
            .withColumn("_cs", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(F.lit(0))).over(siblings))
            .withColumn("_ws", F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("w"))).over(siblings))
        )
        share = F.expr("((cast(_b as decimal(20,0)) - cast(_cs as decimal(20,0))) * cast(w as decimal(16,0))) div _ws")
        parents = nodes.select(*own, F.when(F.col("_full"), F.col("cap")).otherwise(F.least(share, F.col("cap"))).cast("long").alias("budget"))
    return leaves.join(parents.drop("_root"), list(mix.levels), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def epoch_key(mix: Mix, epoch: str = "epochs") -> Column:
    """Where a document stands in the order of an epoch: hexadecimal digits, even whatever the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col(epoch).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf of counted rows: supply, budget, epochs (whole ones), rest (tokens of the epoch after them), and where that
    one ends: cut_key, the key at which it is cut, cut_rest, the tokens left for the rows of that key, and their tokens.
    """
    levels = list(mix.levels)
    leaves = written(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply")), "leaves")
    shares = budgets(leaves, mix).withColumn("epochs", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("long"))
    shares = written(shares.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply")), "shares")
    keyed = rows.join(shares.where("rest > 0").select(*levels, "epochs", "rest"), levels).withColumn("key", epoch_key(mix))
    found = []
    for depth in (1, 2):
        part = F.substring("key", 2 * depth - 1, 2)
        inside = keyed.withColumn("part", part)
        for k, last in enumerate(found, 1):
            inside = inside.join(last.select(*levels, F.col("part").alias("_at"), *([F.col("left").alias("_left")] if k == depth - 1 else [])), levels).where(F.substring("key", 2 * k - 1, 2) == F.col("_at")).drop("_at")
        inside = inside.withColumn("rest", F.col("_left")) if found else inside
        sums = inside.groupBy(*levels, "part").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
        sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*levels).orderBy("part")) - F.col("n"))
        found.append(written(sums.where("before <= rest and rest < before + n").select(*levels, "part", (F.col("rest") - F.col("before")).alias("left")), "cut"))
    last = found[0].withColumnRenamed("part", "_first").drop("left").join(found[1].withColumnRenamed("part", "_second"), levels)
    ends = keyed.join(last, levels).where((F.substring("key", 1, 2) == F.col("_first")) & (F.substring("key", 3, 2) == F.col("_second")))
    ends = ends.groupBy(*levels, "key").agg(F.sum("n_tokens").alias("cut_tokens"), F.max("left").alias("left"))
    ends = ends.withColumn("before", F.sum("cut_tokens").over(Window.partitionBy(*levels).orderBy("key")) - F.col("cut_tokens"))
    ends = ends.where("before <= left and left < before + cut_tokens").select(*levels, F.col("key").alias("cut_key"), (F.col("left") - F.col("before")).alias("cut_rest"), "cut_tokens")
    return written(shares.join(ends, levels, "left"), "cuts")


def taken(rows: DataFrame, at: DataFrame, mix: Mix) -> DataFrame:
    """rows (id, levels, n_tokens and more) with epochs and tokens_taken.

    A leaf's documents come in the order of their keys in each epoch; its budget is a prefix of the epochs laid end to end.
    The document at the cut gives its first tokens only. Rows of one id in one leaf share one place, and at the cut each
    gives tokens in proportion to its own.
    """
    rows = rows.join(at, list(mix.levels), "left").withColumn("epochs", F.coalesce("epochs", F.lit(0).cast("long")))
    key = epoch_key(mix)
    part = F.when(key < F.col("cut_key"), F.col("n_tokens")).when(key == F.col("cut_key"), F.expr("(cut_rest * n_tokens) div cut_tokens")).otherwise(F.lit(0))
    return rows.withColumn("tokens_taken", (F.col("epochs") * F.col("n_tokens") + part).cast("long")).drop("supply", "budget", "rest", "cut_key", "cut_rest", "cut_tokens")


def mixed(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, levels, n_tokens, epochs, tokens_taken) of each row of docs. Tokens are counted once and written down."""
    rows = written(counted(docs, mix, id, text), "tokens")
    return taken(rows, cuts(rows, mix), mix).withColumnRenamed("id", id)
