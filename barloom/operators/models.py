"""Classifiers over windows and token contexts: majority, Markov, logistic, boosted trees."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import argmax, padded_probabilities
from ..session import read_document, write_document
from .quantiles import exact_quantiles

FITTED = "token <> -1"


def with_prediction(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", argmax("probabilities"))


def majority(df: DataFrame, n_classes: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, prediction, probabilities): the most frequent valid token, the smallest of equals, and the frequencies of all."""
    counts = df.where(FITTED).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    out = counts.groupBy(*keys).agg(F.max_by("token", F.struct("n", -F.col("token"))).alias("prediction"), F.map_from_entries(F.collect_list(F.struct("token", F.col("n").cast("double").alias("n")))).alias("_m"), F.sum("n").alias("_t"))
    return out.select(*keys, "prediction", F.transform(padded_probabilities(F.col("_m"), n_classes), lambda x: x / F.col("_t")).alias("probabilities"))


def transitions(df: DataFrame, order: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, state, next, n, p): how often each token follows the last `order` tokens of a context (token_windows)."""
    df = df.where(FITTED).withColumn("state", F.slice("context", -order, order))
    counts = df.groupBy(*keys, "state", F.col("token").alias("next")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys, "state").agg(F.sum("n").alias("_t"))
    return counts.join(totals, [*keys, "state"]).withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def markov_table(df: DataFrame, n_classes: int, order: int = 1) -> tuple[DataFrame, DataFrame]:
    """Probabilities by state, and those for states that never occurred: all tokens' frequencies, or even ones."""
    moves = transitions(df, order)
    by_state = moves.groupBy("state").agg(padded_probabilities(F.map_from_entries(F.collect_list(F.struct("next", "p"))), n_classes).alias("probabilities"))
    even = F.array(*[F.lit(1.0 / n_classes)] * n_classes)
    base = df.where(FITTED).groupBy().agg(*[F.count_if(F.col("token") == k).alias(f"c{k}") for k in range(n_classes)], F.count("*").alias("n"))
    base = base.select(F.when(F.col("n") > 0, F.array(*[F.try_divide(F.col(f"c{k}"), F.col("n")) for k in range(n_classes)])).otherwise(even).alias("default"))
    return by_state, base


def markov_predict(df: DataFrame, table: DataFrame, default: DataFrame, order: int = 1) -> DataFrame:
    """df (context) with probabilities and prediction. There are at most n_classes to the power of order states; Spark decides by
    their size how to join them.
    """
    df = df.withColumn("state", F.slice("context", -order, order)).join(table, "state", "left").join(F.broadcast(default))
    return with_prediction(df.withColumn("probabilities", F.coalesce("probabilities", "default")).drop("default", "state"))


@dataclass
class Majority:
    """The most frequent token of all, whatever the window."""

    prediction: int
    probabilities: list[float]
    n_classes: int

    @staticmethod
    def fit(df: DataFrame, n_classes: int) -> Majority:
        row = majority(df, n_classes).first()
        if row is None:
            raise ValueError("no valid token to learn from")
        return Majority(row["prediction"], list(row["probabilities"]), n_classes)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"prediction": F.lit(self.prediction), "probabilities": F.array(*map(F.lit, self.probabilities))})

    def save(self, spark: SparkSession, path: str) -> None:
        write_document(spark, {"kind": "majority"} | asdict(self), f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str, about: dict) -> Majority:
        return Majority(**about)


@dataclass
class Markov:
    """Probabilities of the next token by the last `order` ones; states are a table, as there may be many."""

    table: DataFrame
    default: list[float]
    order: int
    n_classes: int

    @staticmethod
    def fit(df: DataFrame, n_classes: int, order: int = 1) -> Markov:
        table, default = markov_table(df, n_classes, order)
        return Markov(table, list(default.first()["default"]), order, n_classes)

    def predict(self, df: DataFrame) -> DataFrame:
        default = df.sparkSession.createDataFrame([(self.default,)], "default array<double>")
        return markov_predict(df, self.table, default, self.order)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/states")
        write_document(spark, {"kind": "markov", "default": self.default, "order": self.order, "n_classes": self.n_classes}, f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str, about: dict) -> Markov:
        return Markov(spark.read.parquet(f"{path}/states"), **about)


def class_weights(df: DataFrame, n_classes: int) -> DataFrame:
    """Balanced weights: rows over classes times rows of the class; joined by token, of which there are n_classes."""
    counts = df.groupBy("token").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    weights = counts.join(F.broadcast(total)).select("token", (F.col("_all") / (n_classes * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), "token")


@dataclass
class Scaler:
    """Exact medians for missing values, then means and population deviations, per place of a window."""

    median: list[float]
    mean: list[float]
    deviation: list[float]

    @staticmethod
    def fit(df: DataFrame, width: int, column: str = "window") -> Scaler:
        """Only values near the medians leave their tasks; means and deviations are summed over whole windows."""
        places = df.select(F.posexplode(column).alias("i", "x"))
        medians = {r["i"]: r["quantiles"][0] for r in exact_quantiles(places, "x", (0.5,), ("i",)).collect() if r["quantiles"]}
        scaler = Scaler([float(medians.get(i, 0.0)) for i in range(width)], [0.0] * width, [1.0] * width)
        found = df.select(Summarizer.metrics("count", "mean").summary(array_to_vector(scaler.filled(column))).alias("s")).select("s.count", vector_to_array("s.mean").alias("mean")).first()
        if found and found["count"]:
            shifted = F.zip_with(scaler.filled(column), F.array(*map(F.lit, found["mean"])), lambda x, m: x - m)
            second = df.select(Summarizer.metrics("normL2").summary(array_to_vector(shifted)).alias("s")).select(vector_to_array("s.normL2").alias("norm")).first()
            scaler.mean = list(found["mean"])
            scaler.deviation = [float(x) / found["count"] ** 0.5 or 1.0 for x in second["norm"]]
        return scaler

    def filled(self, column: str = "window") -> Column:
        """The window with medians where values are missing."""
        return F.zip_with(column, F.array(*map(F.lit, self.median)), lambda x, y: F.coalesce(x, y))

    def apply(self, column: str = "window") -> Column:
        a, s = (F.array(*map(F.lit, x)) for x in (self.mean, self.deviation))
        return F.zip_with(F.zip_with(self.filled(column), a, lambda x, y: x - y), s, lambda x, y: x / y)


@dataclass
class Logistic:
    """Multinomial logistic regression with an L2 penalty that equals C of 1 for sums of losses."""

    scaler: Scaler
    model: LogisticRegressionModel
    n_classes: int

    @staticmethod
    def fit(df: DataFrame, n_classes: int, width: int, max_iter: int = 1000) -> Logistic:
        df = df.where(FITTED).select("window", "token")
        scaler = Scaler.fit(df, width)
        ready = df.select(array_to_vector(scaler.apply()).alias("features"), F.col("token").cast("double").alias("label")).cache()
        n = ready.count()
        lr = LogisticRegression(family="multinomial", regParam=1 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
        model = lr.fit(ready)
        ready.unpersist()
        return Logistic(scaler, model, n_classes)

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df.withColumn("features", array_to_vector(self.scaler.apply()))).drop("features", "rawPrediction", "prediction")
        known = F.map_from_entries(F.transform(vector_to_array("probability"), lambda p, i: F.struct(i, p)))
        return with_prediction(scored.withColumn("probabilities", padded_probabilities(known, self.n_classes)).drop("probability"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_document(spark, {"kind": "logistic", "scaler": asdict(self.scaler), "n_classes": self.n_classes}, f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str, about: dict) -> Logistic:
        return Logistic(Scaler(**about["scaler"]), LogisticRegressionModel.load(f"{path}/model"), about["n_classes"])


def best_round(losses: list[float], patience: int) -> int:
    """The number of rounds up to the smallest loss before `patience` rounds in a row bring none that is smaller."""
    best = 0
    for k, x in enumerate(losses):
        if x < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model as it was after n rounds."""
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = java.trees()[k], model.treeWeights[k]
    return GBTClassificationModel(ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), 2))


#: Rounds without a smaller loss on the validation split after which boosting stops.
PATIENCE = 10


@dataclass
class Boosted:
    """Gradient-boosted trees, one against the rest, with balanced weights; probabilities from the classes' raw scores. With rows to
    validate on, each class keeps the rounds up to its smallest loss there.
    """

    scaler: Scaler
    model: object
    n_classes: int

    @staticmethod
    def fit(df: DataFrame, n_classes: int, width: int, rounds: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 42, leaf_rows: int = 1, row_share: float = 1.0, column_share: float = 1.0, val: DataFrame | None = None) -> Boosted:
        df = df.where(FITTED).select("window", "token")
        scaler = Scaler.fit(df, width)
        vector = array_to_vector(scaler.filled()).alias("features")
        ready = class_weights(df, n_classes).select(vector, F.col("token").cast("double").alias("label"), "weight")
        columns = "all" if column_share >= 1 else str(column_share)
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, minInstancesPerNode=leaf_rows, subsamplingRate=row_share, featureSubsetStrategy=columns)
        model = OneVsRest(classifier=trees, weightCol="weight").fit(ready)
        seen = val.where(FITTED).select(vector, "token").cache() if val is not None else None
        if seen is not None and seen.limit(1).count():
            losses = [m.evaluateEachIteration(seen.select("features", (F.col("token") == k).cast("double").alias(m.getLabelCol()), F.lit(1.0).alias("weight"))) for k, m in enumerate(model.models)]
            model = model.copy()
            model.models = [first_trees(m, best_round(x, PATIENCE)) for m, x in zip(model.models, losses, strict=True)]
        if seen is not None:
            seen.unpersist()
        return Boosted(scaler, model, n_classes)

    def rounds(self) -> list[int]:
        return [m.getNumTrees for m in self.model.models]

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df.withColumn("features", array_to_vector(self.scaler.filled()))).drop("features", "prediction")
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        scored = scored.withColumn("_p", raw).withColumn("_t", F.aggregate("_p", F.lit(0.0), lambda a, x: a + x))
        known = F.map_from_entries(F.transform("_p", lambda p, i: F.struct(i, p / F.col("_t"))))
        return with_prediction(scored.withColumn("probabilities", padded_probabilities(known, self.n_classes)).drop("_p", "_t", "rawPrediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_document(spark, {"kind": "boosted", "scaler": asdict(self.scaler), "n_classes": self.n_classes}, f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str, about: dict) -> Boosted:
        return Boosted(Scaler(**about["scaler"]), OneVsRestModel.load(f"{path}/model"), about["n_classes"])

    def importances(self) -> list[list[float]]:
        return [m.featureImportances.toArray().tolist() for m in self.model.models]


MODELS = {"majority": Majority, "markov": Markov, "logistic": Logistic, "boosted": Boosted}


def load_model(spark: SparkSession, path: str) -> Majority | Markov | Logistic | Boosted:
    """A stored model of any kind."""
    about = read_document(spark, f"{path}/about")
    kind = about.pop("kind")
    if kind not in MODELS:
        raise ValueError(f"unknown model: {kind}")
    return MODELS[kind].load(spark, path, about)
