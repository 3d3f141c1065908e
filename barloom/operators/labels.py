"""Labels: normalised forward moves, cut into tokens at quantiles fitted on training rows only."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clipped_token, nonzero
from ..session import SERIES, read_document, write_document
from .blocks import DEALT, ROWS, dealt
from .features import series
from .quantiles import exact_quantiles

INVALID = -1


def forward_move(horizon: int = 1, keys: tuple[str, ...] = SERIES) -> Column:
    """Move of the close over the horizon in units of ATR; null at a series' end and while ATR warms up."""
    return (F.lead("close", horizon).over(series(keys)) - F.col("close")) / nonzero(F.col("atr"))


def forward_return(horizon: int = 1, keys: tuple[str, ...] = SERIES) -> Column:
    return F.try_divide(F.lead("close", horizon).over(series(keys)), F.col("close")) - 1


def with_forward(df: DataFrame, horizons: dict[int, tuple[str, str]], keys: tuple[str, ...] = SERIES) -> DataFrame:
    """df with the forward move and the forward return over each horizon, in the two columns named for it. They look from blocks of series
    into the rows after each block, so that no task holds a series.
    """
    parts, _ = dealt(df, keys, 0, ROWS, max(horizons))
    own = (*keys, "_block")
    found = {move: forward_move(h, own) for h, (move, _) in horizons.items()} | {back: forward_return(h, own) for h, (_, back) in horizons.items()}
    return parts.withColumns(found).where("_own").drop(*DEALT)


def fit_edges(df: DataFrame, n_classes: int, move: str = "move", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (by keys) with `edges`, exact quantiles of the known moves; evenly spread ones where all moves are equal."""
    out = exact_quantiles(df, move, tuple(k / n_classes for k in range(n_classes + 1)), keys)
    return out.select(*keys, edges_of(F.col("quantiles"), n_classes).alias("edges"), F.col("n").alias("n_fitted"))


def edges_of(quantiles: Column, n_classes: int) -> Column:
    """Quantiles as edges; evenly spread ones between lo and hi where all moves are equal."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(n_classes)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / n_classes)
    return F.when(F.size(F.array_distinct(quantiles)) < 2, spread).otherwise(quantiles)


def fit_all_edges(df: DataFrame, classes: tuple[int, ...], moves: dict[int, str]) -> dict[tuple[int, int], tuple[tuple[float, ...], int]]:
    """(edges, known moves) for each number of classes and each horizon, whose moves are in the named columns: one pass over df."""
    shares = sorted({k / n for n in classes for k in range(n + 1)})
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("move")) for h, c in moves.items()])).alias("m")).select("m.*")
    found = exact_quantiles(rows, "move", tuple(shares), ("horizon",))
    picked = lambda n: F.array(*[F.col("quantiles")[shares.index(k / n)] for k in range(n + 1)])
    rows = found.select("horizon", "n", *[edges_of(picked(n), n).alias(f"edges_{n}") for n in classes]).collect()
    return {(n, r["horizon"]): (tuple(r[f"edges_{n}"] or ()), r["n"]) for r in rows for n in classes}


def with_tokens(df: DataFrame, edges: DataFrame, n_classes: int, move: str = "move", keys: tuple[str, ...] = ()) -> DataFrame:
    """df with token; edges has one row (or one by keys, of which there are as many as series)."""
    joined = df.join(edges.select(*keys, "edges"), list(keys), "left") if keys else df.join(F.broadcast(edges.select("edges")))
    token = F.when(F.col(move).isNull() | F.col("edges").isNull(), F.lit(INVALID)).otherwise(clipped_token(F.size(F.filter("edges", lambda e: e <= F.col(move))) - 1, n_classes))
    return joined.withColumn("token", token.cast("int")).drop("edges")


@dataclass(frozen=True)
class Tokenizer:
    """Fitted edges, for use without a join and for keeping."""

    n_classes: int
    horizon: int
    edges: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, n_classes: int = 3, horizon: int = 1, keys: tuple[str, ...] = SERIES) -> Tokenizer:
        """Needs ten rows for each class."""
        return Tokenizer.of_moves(with_forward(df, {horizon: ("move", "forward_return")}, keys), n_classes, horizon)

    @staticmethod
    def of_moves(df: DataFrame, n_classes: int = 3, horizon: int = 1) -> Tokenizer:
        """The same from known moves over the horizon (column move)."""
        row = fit_edges(df, n_classes).first()
        if row is None or row["n_fitted"] < 10 * n_classes:
            raise ValueError(f"{row['n_fitted'] if row else 0} known moves; {10 * n_classes} are needed")
        return Tokenizer(n_classes, horizon, tuple(row["edges"]))

    def transform(self, df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
        """df with move, forward_return and token."""
        df = with_forward(df, {self.horizon: ("move", "forward_return")}, keys)
        return df.withColumn("token", self.token(F.col("move")))

    def token(self, move: Column) -> Column:
        reached = F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e <= move)) - 1
        return F.when(move.isNull(), INVALID).otherwise(clipped_token(reached, self.n_classes)).cast("int")

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return Tokenizer.fit(df, self.n_classes, self.horizon).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        """A document in any store that Spark reaches."""
        write_document(spark, asdict(self), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tokenizer:
        x = read_document(spark, path)
        return Tokenizer(x["n_classes"], x["horizon"], tuple(x["edges"]))

    def metadata(self) -> dict:
        return {"n_bins": self.n_classes, "horizon": self.horizon, "bin_edges": list(self.edges)}
