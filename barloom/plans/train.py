"""Training, evaluation, grids and inference over all series at once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import class_action, top_probability
from ..operators import evaluate as E
from ..operators import models as M
from ..operators.clean import clean_candles, enough_rows
from ..operators.features import FEATURES, with_indicators
from ..operators.labels import Tokenizer, fit_all_edges, with_forward
from ..operators.split import split_periods, time_split
from ..operators.windows import last_windows, tabular_windows, token_windows
from ..session import SERIES, read_document, stored, write_document
from ..streaming.features import feature_stream

SPLIT_KEYS = (*SERIES, "split")


@dataclass(frozen=True)
class Spec:
    """One cell of a grid."""

    model: str = "logistic"
    n_classes: int = 3
    horizon: int = 1
    length: int = 32
    order: int = 1
    rounds: int = 20
    depth: int = 3
    rate: float = 0.1
    leaf_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0


def features_and_tokens(candles: DataFrame, spec: Spec, least_train: int = 1000) -> tuple[DataFrame, Tokenizer]:
    """Clean, split by time, then features and moves within each split; tokens are fitted on the training split alone."""
    parts = stored(time_split(clean_candles(candles), least_train=least_train).where("split is not null"), "split")
    frame = stored(with_forward(with_indicators(parts, SPLIT_KEYS), {spec.horizon: ("move", "forward_return")}, SPLIT_KEYS), "moves")
    tokenizer = Tokenizer.of_moves(frame.where("split = 'train'"), spec.n_classes, spec.horizon)
    return frame.withColumn("token", tokenizer.token(F.col("move"))), tokenizer


def windows_for(frame: DataFrame, spec: Spec, features: tuple[str, ...] = FEATURES) -> DataFrame:
    if spec.model == "markov":
        return token_windows(frame, max(spec.order, spec.length), spec.horizon, SPLIT_KEYS)
    return tabular_windows(frame, spec.length, list(features), SPLIT_KEYS)


def fit_and_predict(windows: DataFrame, spec: Spec, features: tuple[str, ...] = FEATURES) -> tuple[DataFrame, object]:
    """All splits with probabilities and prediction of a model fitted on the training split."""
    train = windows.where("split = 'train'")
    width = spec.length * len(features)
    if spec.model == "majority":
        fitted = M.Majority.fit(train, spec.n_classes)
    elif spec.model == "markov":
        fitted = M.Markov.fit(train, spec.n_classes, spec.order)
    elif spec.model == "logistic":
        fitted = M.Logistic.fit(train, spec.n_classes, width)
    elif spec.model == "boosted":
        shares = dict(leaf_rows=spec.leaf_rows, row_share=spec.row_share, column_share=spec.column_share)
        fitted = M.Boosted.fit(train, spec.n_classes, width, spec.rounds, spec.depth, spec.rate, val=windows.where("split = 'val'"), **shares)
    else:
        raise ValueError(f"unknown model: {spec.model}")
    return fitted.predict(windows), fitted


def evaluated(predicted: DataFrame) -> DataFrame:
    """Class metrics and log loss by split."""
    scores = E.class_metrics(E.confusion(predicted, ("split",)), ("split",))
    return scores.join(E.log_loss(predicted, ("split",)), "split")


def train(candles: DataFrame, spec: Spec, out: str | None = None, least_train: int = 1000, version: str = "latest") -> tuple[DataFrame, object, Tokenizer]:
    """The metrics of each split, the model and the tokenizer; with out, also model, tokenizer and metadata in any store that Spark
    reaches, from which `infer_stored` answers. Features and predictions are written down once and read by all that follows.
    """
    spark = candles.sparkSession
    enough_rows(candles, spec.length, spec.horizon)
    frame, tokenizer = features_and_tokens(candles, spec, least_train)
    predicted, model = fit_and_predict(windows_for(frame, spec), spec)
    metrics = evaluated(stored(predicted.select("split", "token", "prediction", "probabilities"), "predicted"))
    if out:
        model.save(spark, f"{out}/model")
        tokenizer.save(spark, f"{out}/tokenizer")
        periods = [r.asDict() for r in split_periods(frame).collect()]
        write_document(spark, {"version": version, "model": asdict(spec), "feature_set": list(FEATURES), "tokenizer": tokenizer.metadata(), "periods": periods, "metrics": [r.asDict() for r in metrics.collect()]}, f"{out}/metadata")
    return metrics, model, tokenizer


RESULT = "cell string, model string, n_classes int, horizon int, length int, val_macro_f1 double, val_action_accuracy double, test_macro_f1 double, test_action_accuracy double, error string"


@dataclass(frozen=True)
class Prepared:
    """What the cells of a grid share: cleaned and split candles with indicators, and for each horizon the moves and for each number of
    classes the tokens, all as columns of one table that is written once.
    """

    frame: DataFrame
    #: Why tokens could not be fitted.
    errors: dict[tuple[int, int], str]

    @staticmethod
    def of(candles: DataFrame, specs: list[Spec], least_train: int) -> Prepared:
        parts = stored(time_split(clean_candles(candles), least_train=least_train).where("split is not null"), "split")
        horizons, classes = sorted({s.horizon for s in specs}), tuple(sorted({s.n_classes for s in specs}))
        frame = stored(with_forward(with_indicators(parts, SPLIT_KEYS), {h: (f"move_{h}", f"forward_return_{h}") for h in horizons}, SPLIT_KEYS), "moves")
        edges = fit_all_edges(frame.where("split = 'train'"), classes, {h: f"move_{h}" for h in horizons})
        tokens, errors = {}, {}
        for (n, h), (found, known) in edges.items():
            if known < 10 * n:
                errors[n, h] = f"{known} known moves; {10 * n} are needed"
            else:
                tokens[f"token_{n}_{h}"] = Tokenizer(n, h, found).token(F.col(f"move_{h}"))
        errors |= {(n, h): "no moves" for n in classes for h in horizons if (n, h) not in edges}
        return Prepared(stored(frame.withColumns(tokens), "tokens"), errors)

    def cell(self, rows: DataFrame, spec: Spec) -> DataFrame:
        """rows with the token, move and forward return of a cell."""
        if (spec.n_classes, spec.horizon) in self.errors:
            raise ValueError(self.errors[spec.n_classes, spec.horizon])
        return rows.withColumns({"token": F.col(f"token_{spec.n_classes}_{spec.horizon}"), "move": F.col(f"move_{spec.horizon}"), "forward_return": F.col(f"forward_return_{spec.horizon}")})


def cell_name(spec: Spec) -> str:
    return json.dumps(asdict(spec), sort_keys=True)


def research(spark: SparkSession, candles: DataFrame, specs: list[Spec], least_train: int = 1000, ledger: str | None = None) -> DataFrame:
    """A row of validation and test figures for each cell of a grid; a cell that fails has its error. What comes to the driver is a
    cell's few figures.

    Indicators, moves and tokens of all cells are made once, feature windows once for each length. With a ledger, a folder, each
    cell's row is added there when it is done, and cells that are there without an error are not done again.
    """
    done = {}
    if ledger and spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)):
        done = {r["cell"]: r for r in spark.read.schema(RESULT).json(ledger).where("error is null").collect()}
    left = [s for s in specs if cell_name(s) not in done]
    shared = Prepared.of(candles, left, least_train) if left else None
    windows: dict[int, DataFrame] = {}
    for spec in sorted(left, key=lambda s: s.length):
        row = dict(cell=cell_name(spec), model=spec.model, n_classes=spec.n_classes, horizon=spec.horizon, length=spec.length, val_macro_f1=None, val_action_accuracy=None, test_macro_f1=None, test_action_accuracy=None, error=None)
        try:
            if spec.model == "markov":
                rows = windows_for(shared.cell(shared.frame, spec), spec)
            else:
                if spec.length not in windows:
                    windows = {spec.length: stored(tabular_windows(shared.frame, spec.length, list(FEATURES), SPLIT_KEYS, None).drop(*FEATURES), "windows")}
                rows = shared.cell(windows[spec.length], spec).where("token <> -1")
            predicted = stored(fit_and_predict(rows, spec)[0].drop("window"), "predicted")
            for r in evaluated(predicted).collect():
                if r["split"] != "train":
                    row[f"{r['split']}_macro_f1"] = r["macro_f1"]
            for r in E.trading_summary(predicted, spec.n_classes, keys=("split",)).collect():
                if r["split"] != "train":
                    row[f"{r['split']}_action_accuracy"] = r["action_accuracy"]
        except Exception as e:  # noqa: BLE001  a cell of the grid may be impossible
            row["error"] = str(e)[:500]
        done[row["cell"]] = Row(**row)
        if ledger:
            spark.createDataFrame([Row(**row)], RESULT).coalesce(1).write.mode("append").json(ledger)
    names = [f.split()[0] for f in RESULT.split(", ")]
    return spark.createDataFrame([tuple(done[cell_name(s)][n] for n in names) for s in specs], RESULT).drop("cell")


def grid(full: bool = True) -> list[Spec]:
    """Three numbers of classes, horizons and lengths by six models; logistic regression is left out of the longest windows."""
    boosted = [Spec("boosted", rounds=160, depth=3, rate=0.04, leaf_rows=80, row_share=0.8, column_share=0.8), Spec("boosted", rounds=220, depth=4, rate=0.025, leaf_rows=50, row_share=0.85, column_share=0.85)]
    models = [Spec("majority"), Spec("markov", order=1), Spec("markov", order=2), Spec("logistic"), *boosted]
    shapes = [(k, h, n) for k in (3, 5, 7) for h in (1, 3, 6) for n in (16, 32, 64)] if full else [(3, 1, 16)]
    return [replace(m, n_classes=k, horizon=h, length=n) for k, h, n in shapes for m in models if not (m.model == "logistic" and n == 64)]


def infer(candles: DataFrame, model, n_classes: int, length: int = 32, version: str = "latest") -> DataFrame:
    """One answer per series from its last window: token, probabilities, action and confidence. Candles are taken as they come:
    neither cleaned nor freed of copies. Models of token contexts cannot answer.
    """
    if isinstance(model, M.Markov):
        raise ValueError("a Markov model has no features to answer from")
    w = last_windows(with_indicators(candles), length, list(FEATURES))
    counts = candles.groupBy(*SERIES).agg(F.count("*").alias("n_candles_used"))
    scored = model.predict(w.withColumn("window", F.flatten("window"))).join(counts, list(SERIES))
    return scored.select(*SERIES, F.col("last_begin").alias("timestamp"), *answer(n_classes, version), "n_candles_used")


def infer_stream(candles: DataFrame, model, n_classes: int, length: int = 32, late: str = "1 day", version: str = "latest") -> DataFrame:
    """An answer for each candle of a stream when the watermark has passed it, from the last `length` rows that are kept of its series;
    while there are fewer, none.
    """
    if isinstance(model, M.Markov):
        raise ValueError("a Markov model has no features to answer from")
    scored = model.predict(feature_stream(candles, late, length).where("window is not null"))
    return scored.select(*SERIES, F.col("begin").alias("timestamp"), *answer(n_classes, version))


def answer(n_classes: int, version: str) -> list[Column]:
    """What is said of a prediction."""
    return [F.col("prediction").alias("predicted_token"), F.col("probabilities"), class_action("prediction", n_classes).alias("action"), top_probability("probabilities").alias("confidence"), F.lit(version).alias("model_version")]


def infer_stored(candles: DataFrame, path: str) -> DataFrame:
    """The same by what `train` has stored at path, with its window length, classes and version."""
    spark = candles.sparkSession
    about = read_document(spark, f"{path}/metadata")
    spec = Spec(**about["model"])
    return infer(candles, M.load_model(spark, f"{path}/model"), spec.n_classes, spec.length, about["version"])
