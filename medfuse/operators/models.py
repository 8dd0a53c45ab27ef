"""M3-M7: Spark ML pipelines for the baseline, two-headed and fusion models.

The reference's Keras networks are re-aimed as Spark ML estimators (fitted
distributed, tree-aggregated gradients): a logistic-regression (or MLP / GBT)
class head for ``CVD_Presence`` and a linear (or GBT) regression head for
``Time_To_Event`` over one assembled feature vector.  The fusion model (M5)
assembles and scales each modality separately, then fuses the scaled vectors.
One fitted ``PipelineModel`` serves training, evaluation and scoring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, Imputer, ImputerModel, Interaction, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.operators.clean import numeric_columns
from medfuse.session import materialize
from medfuse.sources.fixtures import KEY, LABEL_COLS

CLASS_LABEL, REG_LABEL = LABEL_COLS
COUNTED = 200             # columns that one aggregate of ``observed`` counts, so that its plan stays small on the driver
FUSED_COMPONENTS = 3      # leading components of a modality that the fusion multiplies with the next one's


def modality_layout(mods: dict[str, DataFrame], matrix: DataFrame, key: str = KEY, labels: Sequence[str] = LABEL_COLS,
                    time: str = "time") -> dict[str, list[str]]:
    """Which matrix columns each modality gave, in the order of its own columns.

    Taken from the modality frames themselves, never guessed from names: a prefixed column per numeric
    column, and for the wearables every ``<signal>__`` feature of each of their signals.
    """
    out = {}
    for name, df in mods.items():
        own = numeric_columns(df, [key, time, *labels])
        if name == "wearables":
            out[name] = [c for c in matrix.columns if any(c.startswith(f"{s}__") for s in own)]
        else:
            out[name] = [c if name == "ehr" else f"{name}_{c}" for c in own]
    return out


def observed(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(finite values, NaN or infinite values) of each column; one aggregate for every ``COUNTED`` columns."""
    out = {}
    for at in range(0, len(cols), COUNTED):
        some = cols[at:at + COUNTED]
        value = [f"CAST(`{c}` AS DOUBLE)" for c in some]
        row = df.select(*[f"`{c}`" for c in some]).agg(
            *[F.expr(f"count_if(abs({v}) < double('Infinity'))").alias(f"f{i}") for i, v in enumerate(value)],
            *[F.expr(f"count_if(NOT abs({v}) < double('Infinity'))").alias(f"b{i}") for i, v in enumerate(value)]).first()
        out |= {c: (row[f"f{i}"], row[f"b{i}"]) for i, c in enumerate(some)}
    return out


def usable_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Drop columns with no finite value on ``df`` (Imputer cannot fit them); one aggregate."""
    return [c for c, (n, _) in observed(df, cols).items() if n > 0]


def _class_head(kind: str, n_features: int, validation_col: str | None, seed: int):
    common = dict(featuresCol="features", labelCol=CLASS_LABEL, predictionCol="pred_class",
                  probabilityCol="cls_probability", rawPredictionCol="cls_raw")
    if kind == "logistic":
        return LogisticRegression(maxIter=100, regParam=0.01, elasticNetParam=0.0, tol=1e-6, **common)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 128, 64, 2], maxIter=100, blockSize=32,
                                              seed=seed, **common)
    if kind == "gbt":
        gbt = GBTClassifier(featuresCol="features", labelCol=CLASS_LABEL, predictionCol="pred_class", maxIter=100,
                            maxDepth=3, seed=seed, validationIndicatorCol=validation_col, validationTol=0.01)
        return gbt.setProbabilityCol("cls_probability").setRawPredictionCol("cls_raw")
    raise ValueError(kind)


def _reg_head(kind: str, validation_col: str | None, seed: int):
    common = dict(featuresCol="features", labelCol=REG_LABEL, predictionCol="pred_time")
    if kind == "linear":
        return LinearRegression(maxIter=100, regParam=0.01, **common)
    if kind == "gbt":
        return GBTRegressor(maxIter=100, maxDepth=3, seed=seed, validationIndicatorCol=validation_col,
                            validationTol=0.01, **common)
    raise ValueError(kind)


def build_pipeline(columns: dict[str, list[str]], fusion: bool = True, classifier: str = "logistic",
                   regressor: str | None = "linear", validation_col: str | None = None, seed: int = 42) -> Pipeline:
    """M4/M5 (M3 with ``regressor=None`` and one modality).

    Stages: Imputer (train means, NULL and NaN) -> per-modality assemble + scale
    (fusion) or one assemble + scale (flat) -> class head [-> regression head].
    The fusion also multiplies the leading components of each modality with those
    of the next one, so that it can learn what modalities say together.
    """
    all_cols = [c for cols in columns.values() for c in cols]
    imputed = {c: f"{c}__imp" for c in all_cols}
    stages = [Imputer(inputCols=all_cols, outputCols=[imputed[c] for c in all_cols], strategy="mean")]
    if fusion:
        scaled = []
        stages += [VectorAssembler(inputCols=[imputed[c] for c in cols], outputCol=f"{m}_vec", handleInvalid="keep")
                   for m, cols in columns.items()]        # all that read feature columns come first (``wide_stages``)
        for m, cols in columns.items():
            stages.append(StandardScaler(inputCol=f"{m}_vec", outputCol=f"{m}_scaled", withMean=True, withStd=True))
            stages.append(PCA(k=min(FUSED_COMPONENTS, len(cols)), inputCol=f"{m}_scaled", outputCol=f"{m}_pca"))
            stages.append(VectorAssembler(inputCols=[f"{m}_pca"], outputCol=f"{m}_lead"))     # names what Interaction multiplies
            scaled.append(f"{m}_scaled")
        crossed = []
        for a, b in zip(columns, list(columns)[1:]):
            stages.append(Interaction(inputCols=[f"{a}_lead", f"{b}_lead"], outputCol=f"{a}_x_{b}"))
            crossed.append(f"{a}_x_{b}")
        stages.append(VectorAssembler(inputCols=scaled + crossed, outputCol="features"))
    else:
        stages.append(VectorAssembler(inputCols=[imputed[c] for c in all_cols], outputCol="raw_features",
                                      handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    stages.append(_class_head(classifier, len(feature_names(columns, fusion)), validation_col, seed))
    if regressor:
        stages.append(_reg_head(regressor, validation_col, seed))
    return Pipeline(stages=stages)


def feature_names(columns: dict[str, list[str]], fusion: bool = False) -> list[str]:
    """Order of the entries of the ``features`` vector."""
    names = [c for cols in columns.values() for c in cols]
    if fusion:
        for a, b in zip(columns, list(columns)[1:]):
            names += [f"{a}_pc{i}_x_{b}_pc{j}" for i in range(min(FUSED_COMPONENTS, len(columns[a])))
                      for j in range(min(FUSED_COMPONENTS, len(columns[b])))]
    return names


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """``Pipeline.fit`` whose heads learn from the rows that have their label.

    A patient may have one label and not the other (no event yet), and Spark's heads raise on a NULL or NaN label.  All
    other stages learn from every row.
    """
    fitted, stages = [], pipeline.getStages()
    last = max((i for i, st in enumerate(stages) if isinstance(st, Estimator)), default=-1)
    for i, st in enumerate(stages):
        if isinstance(st, Estimator):
            st = st.fit(train.where(has_label(st.getLabelCol())) if st.hasParam("labelCol") else train)
        fitted.append(st)
        if i < last:
            train = st.transform(train)
    return PipelineModel(fitted)


def has_label(label: str) -> Column:
    return F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))


def wide_stages(stages: Sequence) -> int:
    """How many leading stages read feature columns: the imputer and the assemblers of what it filled."""
    if not stages or not isinstance(stages[0], (Imputer, ImputerModel)):
        return 0
    filled, n = set(stages[0].getOutputCols()), 1
    while n < len(stages) and isinstance(stages[n], VectorAssembler) and filled.issuperset(stages[n].getInputCols()):
        n += 1
    return n


def assemble(stages: Sequence, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and the vectors that the ``wide_stages`` of a model make of the others."""
    vectors = [st.getOutputCol() for st in stages[1:]]
    return PipelineModel(list(stages)).transform(df).select(*keep, *vectors)


def fit_assembled(pipeline: Pipeline, rows: DataFrame, train: Column, keep: Sequence[str]) -> tuple[PipelineModel, PipelineModel, DataFrame]:
    """Fit on the rows of ``rows`` where ``train`` holds: (model, its stages after the vectors, the written vectors of all rows).

    The model is that of ``fit``.  Every scaler, component and head here reads a written table of the columns
    ``keep`` and a few vectors, while there each of their plans fills and assembles every feature column again.
    """
    stages = pipeline.getStages()
    n = wide_stages(stages)
    wide = Pipeline(stages=stages[:n]).fit(rows.where(train)).stages
    vectors = materialize(assemble(wide, rows, keep))
    rest = fit(Pipeline(stages=stages[n:]), vectors.where(train))
    return PipelineModel([*wide, *rest.stages]), rest, vectors


def declared_model(class_weights: dict[str, float], class_intercept: float, reg_weights: dict[str, float],
                   reg_intercept: float) -> PipelineModel:
    """A two-headed linear model with given coefficients on raw columns; a missing or non-finite value counts as 0.

    It saves, loads and scores like a fitted one.
    """
    def linear(weights: dict[str, float], intercept: float) -> str:
        return " + ".join([f"{w!r}D * IF(abs(CAST(`{c}` AS DOUBLE)) < double('Infinity'), CAST(`{c}` AS DOUBLE), 0D)" for c, w in weights.items()]
                          + [f"{intercept!r}D"])

    inner = f"SELECT *, 1 / (1 + exp(-({linear(class_weights, class_intercept)}))) AS p_class1, {linear(reg_weights, reg_intercept)} AS pred_time FROM __THIS__"
    return PipelineModel([SQLTransformer(statement=f"SELECT *, CAST(IF(p_class1 > 0.5, 1, 0) AS DOUBLE) AS pred_class FROM ({inner})")])


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """M7: ``p_class1`` (probability of class 1), ``pred_class`` (int), ``pred_time`` when present.

    ``keep``: the columns of ``df`` that the caller needs beside them (default all); the feature columns then stay out of
    the plans of the stages after the vectors.
    """
    n = wide_stages(model.stages) if keep is not None else 0
    out = PipelineModel(model.stages[n:]).transform(assemble(model.stages[:n], df, keep)) if n else model.transform(df)
    if "p_class1" not in out.columns:
        out = out.withColumn("p_class1", vector_to_array("cls_probability").getItem(1))
    return out.withColumn("pred_class", F.col("pred_class").cast("int"))
