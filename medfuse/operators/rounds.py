"""M6: two-headed training in rounds with early stopping, for linear and hidden-layer heads.

One network of any number of hidden layers (none: a logistic and a linear head on the features themselves) with a class
head and a regression head is trained on the sum of cross-entropy and squared error.  Every round is one pass: the
tasks hold the rows as Arrow batches and add up the gradient of the training rows and the losses of both parts at the
current weights; the sums by position are a Spark aggregate, and the driver, which only ever holds weights, takes the
step from where the round before ended.  Training stops after ``patience`` rounds without a smaller validation loss and
goes back to the weights of the best round.  The losses and the weights of every round can be written as tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from medfuse.functions.exprs import DOUBLE_EPS, finite_or_null
from medfuse.operators.models import CLASS_LABEL, REG_LABEL
from medfuse.session import materialize

LOSSES = ("train_cross_entropy", "train_mse", "valid_cross_entropy", "valid_mse")


@dataclass(frozen=True)
class RoundSettings:
    hidden: tuple[int, ...] = ()
    rounds: int = 100
    patience: int = 10
    step: float = 0.05
    momentum: str = "adam"          # "adam", or "none" for plain gradient steps
    seed: int = 42


@dataclass
class Scale:
    """Training means and population deviations (0 counts as 1) of the features, and of the regression target."""

    columns: list[str]
    mean: np.ndarray
    std: np.ndarray
    y_mean: float
    y_std: float


@dataclass
class RoundsModel:
    scale: Scale
    sizes: list[int]
    weights: np.ndarray                             # of the best round
    best_round: int
    path: list[tuple[int, float, float, float, float]]      # (round, *LOSSES)
    history: list[np.ndarray]                       # weights of every round


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Weight matrices, the bias as their last row."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(flat[at:at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Zeros without a hidden layer; else seeded and scaled by the width of the layer below, with zero biases."""
    if len(sizes) == 2:
        return np.zeros((sizes[0] + 1) * sizes[1])
    rng = np.random.default_rng(seed)
    return np.concatenate([np.vstack([rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros((1, b))]).ravel() for a, b in zip(sizes, sizes[1:])])


def forward(x: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Values of every layer; the last has the class margin and the (scaled) regression value."""
    out = [x]
    for i, w in enumerate(weights):
        z = out[-1] @ w[:-1] + w[-1]
        out.append(np.maximum(z, 0) if i < len(weights) - 1 else z)
    return out


def cross_entropy(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - label * margin


def batch_sums(x: np.ndarray, label: np.ndarray, y: np.ndarray, validation: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Gradient sums of the training rows, then (cross-entropy, squared error, rows) of training and of validation rows."""
    layers = forward(x, weights)
    margin, value = layers[-1][:, 0], layers[-1][:, 1]
    losses = np.stack([cross_entropy(margin, label), (value - y) ** 2, np.ones(len(x))])
    back = np.stack([0.5 * (1 + np.tanh(margin / 2)) - label, 2 * (value - y)], 1) * ~validation[:, None]
    gradients = []
    for i in range(len(weights) - 1, -1, -1):
        gradients.append(np.vstack([layers[i].T @ back, back.sum(0)]).ravel())
        if i:
            back = (back @ weights[i][:-1].T) * (layers[i] > 0)
    return np.concatenate([*gradients[::-1], losses[:, ~validation].sum(1), losses[:, validation].sum(1)])


def _round(flat: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = unpack(flat, sizes), np.zeros(len(flat) + 6)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, sizes[0])
                label, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                total += batch_sums(x, label, y, b.column(3).to_numpy(zero_copy_only=False).astype(bool), weights)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])
    return run


def fit_scale(train: DataFrame, columns: Sequence[str]) -> Scale:
    """One aggregate over the training rows; a column without a finite value has mean 0 and deviation 0."""
    names = [*columns, REG_LABEL]
    clean = finite_or_null(train.select(*[F.col(f"`{c}`") for c in names]), names)
    row = clean.selectExpr(*[f"avg(`{c}`) AS m{i}" for i, c in enumerate(names)], *[f"stddev_pop(`{c}`) AS s{i}" for i, c in enumerate(names)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(names))])
    std = np.array([row[f"s{i}"] or 0.0 for i in range(len(names))])
    std[std <= DOUBLE_EPS] = 1.0
    return Scale(list(columns), mean[:-1], std[:-1], float(mean[-1]), float(std[-1]))


def scaled_rows(df: DataFrame, scale: Scale) -> DataFrame:
    """``df`` with ``x``: the scaled features as an array, 0 (the training mean) where a value is missing or not finite."""
    clean = finite_or_null(df, scale.columns)
    values = [f"coalesce((`{c}` - {m!r}D) / {s!r}D, 0D)" for c, m, s in zip(scale.columns, scale.mean.tolist(), scale.std.tolist())]
    return clean.withColumn("x", F.expr(f"array({', '.join(values)})"))


def fit_rounds(df: DataFrame, columns: Sequence[str], settings: RoundSettings = RoundSettings(), split: str = "split") -> RoundsModel:
    """Train on the rows of ``df`` whose ``split`` is 'train', stop by those that are 'validation'; others are not read.

    Rows without a class label or a regression target teach nothing and are left out.  Missing features count as the
    training mean.  Without a validation row the training loss decides; without a training row this raises.
    """
    part = F.col(split)
    known = df.where(part.isin("train", "validation") & F.col(CLASS_LABEL).isNotNull() & F.col(REG_LABEL).isNotNull())
    scale = fit_scale(known.where(part == "train"), columns)
    rows = materialize(scaled_rows(known, scale).select(
        "x", F.col(CLASS_LABEL).cast("double").alias("label"), ((F.col(REG_LABEL).cast("double") - scale.y_mean) / scale.y_std).alias("y"),
        (part == "validation").alias("validation")))
    sizes = [len(columns), *settings.hidden, 2]
    flat = first_weights(sizes, settings.seed)
    speed, square = np.zeros_like(flat), np.zeros_like(flat)
    path, history, best, best_round = [], [], np.inf, 0
    for r in range(settings.rounds):
        sums = (rows.mapInArrow(_round(flat, sizes), "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
                .groupBy("at").agg(F.sum("v").alias("v")).collect())            # one row per weight
        total = np.zeros(len(flat) + 6)
        for s in sums:
            total[s["at"]] = s["v"]
        ce, se, n, vce, vse, vn = total[len(flat):]
        if not n:
            raise ValueError("no training row with both labels")
        losses = (ce / n, se / n, vce / vn if vn else ce / n, vse / vn if vn else se / n)
        path.append((r, *map(float, losses)))
        history.append(flat)
        loss = losses[2] + losses[3]
        if loss < best:
            best, best_round = loss, r
        elif r - best_round >= settings.patience:
            break
        gradient = total[:len(flat)] / n
        if settings.momentum == "adam":
            speed, square = 0.9 * speed + 0.1 * gradient, 0.999 * square + 0.001 * gradient ** 2
            gradient = (speed / (1 - 0.9 ** (r + 1))) / (np.sqrt(square / (1 - 0.999 ** (r + 1))) + 1e-8)
        flat = flat - settings.step * gradient
    return RoundsModel(scale, sizes, history[best_round], best_round, path, history)


def predict_rounds(model: RoundsModel, df: DataFrame) -> DataFrame:
    """M7: ``df`` with p_class1, pred_class and pred_time.  Heads without a hidden layer are plain SQL expressions."""
    weights = unpack(model.weights, model.sizes)
    y = f"* {model.scale.y_std!r}D + {model.scale.y_mean!r}D"
    fields = scaled_rows(df, model.scale)
    if len(weights) == 1:
        head = [f"aggregate(zip_with(x, array({', '.join(f'{v!r}D' for v in w[:-1])}), (a, b) -> a * b), {w[-1]!r}D, (t, v) -> t + v)"
                for w in weights[0].T.tolist()]
        out = fields.withColumn("p_class1", F.expr(f"1 / (1 + exp(-({head[0]})))")).withColumn("pred_time", F.expr(f"({head[1]}) {y}"))
    else:
        flat, sizes = model.weights, model.sizes
        at = fields.columns.index("x")

        def run(batches):
            layers = unpack(flat, sizes)
            for b in batches:
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, sizes[0])
                last = forward(x, layers)[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(0.5 * (1 + np.tanh(last[:, 0] / 2))), pa.array(last[:, 1])],
                                                 [*b.schema.names, "p_class1", "pred_time"])
        schema = StructType([*fields.schema.fields, StructField("p_class1", DoubleType()), StructField("pred_time", DoubleType())])
        out = fields.mapInArrow(run, schema).withColumn("pred_time", F.expr(f"pred_time {y}"))
    return out.drop("x").withColumn("pred_class", F.when(F.col("p_class1") > 0.5, 1).otherwise(0))


def loss_path(spark: SparkSession, model: RoundsModel) -> DataFrame:
    """(round, the four losses, valid_loss, best) of every round."""
    rows = [(*p, p[3] + p[4], p[0] == model.best_round) for p in model.path]
    return spark.createDataFrame(rows, "round int, " + ", ".join(f"{n} double" for n in LOSSES) + ", valid_loss double, best boolean")


def coefficients(spark: SparkSession, model: RoundsModel) -> DataFrame:
    """(round, position, value): the weights that each round began with."""
    rows = [(r, i, v) for r, flat in enumerate(model.history) for i, v in enumerate(flat.tolist())]
    return spark.createDataFrame(rows, "round int, position int, value double")
