"""Exact quantiles without a task that holds a group's values: approximate ones bracket them, exact counts settle the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(keys, quantiles, lo, hi, n) of the known values, interpolated between neighbours; a group without values has null quantiles.

    Groups of few values are summed up as they are. Beyond, a sketch, whose ranks are off by a share of 1 / accuracy at most, gives each quantile a lower and an upper bound. One pass
    counts the values below the bounds and, by distinct value, those within, which are some 4 / accuracy of all; only these are
    put in order. Null values count for nothing; keys must be known. Keys and values are written down once, since all of this reads them.
    """
    known = stored(df.select(*keys, F.col(value).cast("double").alias("_v")), "values")
    # Below some number of values a share of 1 / accuracy is less than one rank: a group's distinct values are then few enough to be held.
    most = known.groupBy(*keys).agg(F.count("_v").alias("n")).agg(F.max("n")).first()[0] or 0
    if most < 4 * accuracy:
        q = F.percentile("_v", F.array(*map(F.lit, shares)))
        return known.groupBy(*keys).agg(q.alias("quantiles"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n"))
    off = 2.0 / accuracy
    at = lambda move: F.array(*[F.lit(min(1.0, max(0.0, s + move))) for s in shares])
    rough = known.groupBy(*keys).agg(
        F.percentile_approx("_v", at(-off), accuracy).alias("_low"), F.percentile_approx("_v", at(off), accuracy).alias("_high"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n")
    )
    few = F.col("n") < 4 * accuracy
    rough = rough.withColumns({"_low": F.when(few, F.transform("_low", lambda _: F.col("lo"))).otherwise(F.col("_low")), "_high": F.when(few, F.transform("_high", lambda _: F.col("hi"))).otherwise(F.col("_high"))})
    met = known.where("_v is not null").join(rough.select(*keys, "_low", "_high"), list(keys)) if keys else known.where("_v is not null").join(F.broadcast(rough.select("_low", "_high")))
    places = range(len(shares))
    below = met.groupBy(*keys).agg(F.array(*[F.count_if(F.col("_v") < F.col("_low")[j]) for j in places]).alias("_below"))
    within = F.filter(F.array(*[F.when(F.col("_v").between(F.col("_low")[j], F.col("_high")[j]), F.lit(j)) for j in places]), lambda j: j.isNotNull())
    counts = met.select(*keys, "_v", F.explode(within).alias("_j")).groupBy(*keys, "_j", "_v").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_j").orderBy("_v")))
    facts = rough.join(below, list(keys), "left") if keys else rough.join(F.broadcast(below))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("_j") + 1)
    ranked = counts.join(facts.select(*keys, "_below", "n"), list(keys)) if keys else counts.join(F.broadcast(facts.select("_below", "n")))
    ranked = ranked.withColumn("_rank", (F.col("n") - 1) * share).withColumn("_to", F.col("_to") + F.col("_below")[F.col("_j")]).withColumn("_from", F.col("_to") - F.col("_c"))
    holds = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_to"))
    pick = lambda rank: F.max(F.when(holds(rank), F.col("_v")))
    low, high = F.floor("_rank"), F.ceil("_rank")
    found = ranked.groupBy(*keys, "_j").agg(pick(low).alias("_a"), pick(high).alias("_b"), F.max(F.col("_rank") - low).alias("_part"))
    one = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    lists = found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", one.alias("q")))), lambda x: x["q"]).alias("quantiles"))
    out = rough.select(*keys, "lo", "hi", "n")
    out = out.join(lists, list(keys), "left") if keys else out.join(F.broadcast(lists))
    return out.select(*keys, F.when(F.col("n") > 0, F.col("quantiles")).alias("quantiles"), "lo", "hi", "n")
