"""Training and evaluation scenarios on the feature matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators.metrics import metrics_row
from ..operators.neighbours import smote
from ..operators.network import fit_network, predicted_classes
from ..operators.ordering import assign_folds, held_out_rows, split_exact, with_position
from ..operators.scaling import apply_scaler, fit_scaler
from ..sources.tables import checkpointed

LABEL, KEY, FOLD = "aki_stage_7day", "icustay_id", "fold"
HIDDEN = (256,) * 7
SEED = 1234
# Independent models fitted side by side: one's rounds fill the cores while another's weights are on the driver.
MODELS_AT_ONCE = 4
# Test sets of the transfer between groups; see :func:`transfer_sets`.
ETHNICITY_TESTS = {"group 1": 1, "group 3": 3, "not group 0": None}
TEST_SIZES = [0.02, 0.05, 0.10, 0.20, 0.40, 0.50, 0.60, 0.80, 0.90, 0.95]


def features_of(df: DataFrame) -> list[str]:
    """Every column that is neither key nor label."""
    return [c for c in df.columns if c not in (KEY, *C.LABEL_COLUMNS, "is_synthetic", "is_test", FOLD)]


class Perceptron(MultilayerPerceptronClassifier):
    """Spark's perceptron, its start weights, its L-BFGS and its model; every row counts once.

    Spark's own fit takes the mean over blocks of 128 rows, so the rows of the short last block of each
    part count more, and the loss it lowers depends on how rows are dealt and sorted.
    """

    def _fit(self, dataset: DataFrame) -> Transformer:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        start = self.getInitialWeights() if self.isDefined(self.initialWeights) else self._model(dataset.sparkSession).weights
        weights, _ = fit_network(dataset, self.getFeaturesCol(), self.getLabelCol(), self.getLayers(), start.toArray(),
                                 self.getMaxIter(), self.getTol())
        model = self._model(dataset.sparkSession, weights)
        model.clear(model.initialWeights)
        return model._set(maxIter=self.getMaxIter()).copy()

    def _model(self, spark: SparkSession, weights: np.ndarray | None = None) -> Transformer:
        """Spark's model with these weights, by default those that ``seed`` starts from: a fit of no rounds."""
        given = {} if weights is None else {self.initialWeights: Vectors.dense(weights)}
        row = (0.0, Vectors.dense(np.zeros(self.getLayers()[0])))
        return super(Perceptron, self.copy({self.maxIter: 0, **given}))._fit(
            spark.createDataFrame([row], [self.getLabelCol(), self.getFeaturesCol()]).coalesce(1))


def learner(inputs: int, features: str, kind: str = "mlp", hidden: Sequence[int] = HIDDEN, classes: int = 4,
            max_iter: int = 1000, tol: float = 1e-6, seed: int = SEED, trees: int = 100, depth: int = 10,
            label: str = LABEL) -> Estimator:
    """A classifier over a vector column of ``inputs`` numbers; see :func:`train`."""
    common = {"featuresCol": features, "labelCol": label, "predictionCol": "prediction"}
    return {
        "mlp": lambda: Perceptron(
            layers=[inputs, *hidden, classes], maxIter=max_iter, tol=tol, seed=seed, **common),
        "forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
        "logistic": lambda: LogisticRegression(maxIter=max_iter, tol=tol, **common),
    }[kind]()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, in a fixed order inside each part.

    A feature matrix is small as a file (one part of 128 MB holds some 200,000
    stays) and costly in work, so its file's parts would leave a fit on one core.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(*df.columns)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The rows of all ``jobs`` in their order, ``MODELS_AT_ONCE`` of them run at a time."""
    with ThreadPoolExecutor(MODELS_AT_ONCE) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return reduce(DataFrame.unionByName, [job.result() for job in started])


def train(df: DataFrame, **settings: object) -> PipelineModel:
    """Fits a classifier; all learners train data-parallel on all cores of the executors.

    ``kind="mlp"`` (the default) is a fully connected network with softmax output. Its hidden units
    are sigmoid and it is fitted by L-BFGS, without dropout, until the loss
    stops improving by ``tol`` or after ``max_iter`` rounds. ``forest`` and
    ``logistic`` take the same inputs; a forest has ``trees`` trees of ``depth`` levels.
    """
    columns = features_of(df)
    assembler = VectorAssembler(inputCols=columns, outputCol="_features")
    rows = assembler.transform(spread(df.select(*columns, settings.get("label", LABEL))))
    return PipelineModel([assembler, learner(len(columns), "_features", **settings).fit(rows)])


def with_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """The rows with their ``fold``, written once."""
    return checkpointed(assign_folds(df, KEY, k, SEED))


def cross_validate(df: DataFrame, grid: dict[str, Sequence[object]] | None = None, k: int = 5, kind: str = "logistic",
                   **settings: object) -> DataFrame:
    """Model selection over ``k`` exact folds: one row per fold and setting of ``grid`` (parameter name to values).

    Every setting is trained on k - 1 folds and judged on the other one, and
    scaling is fitted on the same rows as the model. ``chosen`` marks the
    setting with the best mean accuracy over the folds, of equal ones the first.
    Folds are those of :func:`with_folds`, so a repeated run meets the same rows.
    """
    columns, folds = features_of(df), with_folds(df, k)
    model = learner(len(columns), "_scaled", kind, **settings)
    stages = [VectorAssembler(inputCols=columns, outputCol="_features"),
              StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True), model]
    builder = ParamGridBuilder()
    for name, values in (grid or {}).items():
        builder.addGrid(model.getParam(name), list(values))
    choices = builder.build()
    fitted = CrossValidator(
        estimator=Pipeline(stages=stages), estimatorParamMaps=choices, numFolds=k, foldCol=FOLD, collectSubModels=True,
        evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")).fit(folds)
    best = max(range(len(choices)), key=lambda i: fitted.avgMetrics[i])
    rows = [metrics_row(predict(fitted.subModels[fold][i], folds.where(F.col(FOLD) == fold)), LABEL, "predicted",
                        fold=fold, **{param.name: value for param, value in choice.items()}, chosen=i == best)
            for fold in range(k) for i, choice in enumerate(choices)]
    return reduce(DataFrame.unionByName, rows)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def predict(model: Transformer, df: DataFrame) -> DataFrame:
    """Key, labels and predicted class of every row; a network's outputs are worked out for many rows at once."""
    kept = [c for c in df.columns if c in (KEY, *C.LABEL_COLUMNS)]
    *before, last = model.stages if isinstance(model, PipelineModel) else [model]
    if isinstance(last, MultilayerPerceptronClassificationModel) and not last.isSet(last.thresholds):
        return predicted_classes(PipelineModel(before).transform(df), last.getFeaturesCol(), kept, last.getLayers(),
                                 last.weights.toArray())
    return model.transform(df).select(*kept, F.col("prediction").cast("int").alias("predicted"))


def _scaled(fit_on: DataFrame, *sets: DataFrame) -> list[DataFrame]:
    columns = features_of(fit_on)
    scaler = checkpointed(fit_scaler(fit_on, columns))
    return [apply_scaler(s, scaler, columns) for s in sets]


def _evaluate(model: Transformer, sets: dict[str, DataFrame], scenario: str) -> DataFrame:
    rows = [metrics_row(predict(model, df), LABEL, "predicted", scenario=scenario, test_set=name)
            for name, df in sets.items()]
    return reduce(DataFrame.unionByName, rows)


def _ordered(df: DataFrame) -> DataFrame:
    """All rows with their place in one random order, written once."""
    return checkpointed(with_position(df, KEY, SEED))


def _cut(ordered: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Raw training and test rows."""
    is_test = F.col("_pos") <= held_out_rows(F.col("_n"), size)
    return tuple(ordered.where(part).drop("_pos", "_n") for part in (~is_test, is_test))


def _train_test(ordered: DataFrame, size: float, fit_on: str) -> tuple[DataFrame, DataFrame]:
    """Cut at ``size``, then scaled by the training rows (or by all, ``fit_on="all"``)."""
    train_set, test_set = _cut(ordered, size)
    return tuple(_scaled(ordered.drop("_pos", "_n") if fit_on == "all" else train_set, train_set, test_set))


def overall(df: DataFrame, fit_on: str = "train", **learner: object) -> DataFrame:
    """80/20 split of all stays; metrics on both parts."""
    train_set, test_set = _train_test(_ordered(df), 0.2, fit_on)
    model = train(train_set, **learner)
    return _evaluate(model, {"train": train_set, "test": test_set}, "overall")


def by_size(df: DataFrame, sizes: Sequence[float] = TEST_SIZES, fit_on: str = "train",
               **learner: object) -> DataFrame:
    """One model per test fraction; all splits are cuts of one random order."""
    ordered = _ordered(df)

    def at(size: float) -> DataFrame:
        train_set, test_set = _train_test(ordered, size, fit_on)
        return _evaluate(train(train_set, **learner), {"test": test_set}, f"test size {size}")

    return side_by_side(df.sparkSession, [lambda size=size: at(size) for size in sizes])


def transfer_sets(df: DataFrame, column: str, train_value: int, others: dict[str, object],
                  size: float = 0.2) -> dict[str, DataFrame]:
    """Raw training and test sets of a transfer scenario.

    ``train`` and ``test`` split the rows with ``train_value``. ``others`` maps
    a name to a value of the column (a test part of those rows), to None (all
    rows without ``train_value``) or to ``(value,)`` (all rows with a value).
    """
    code = F.col(column)
    parts = checkpointed(split_exact(df, KEY, size, SEED, [column]))
    held, every = parts.where(F.col("is_test")).drop("is_test"), parts.drop("is_test")
    sets = {"train": parts.where((code == train_value) & ~F.col("is_test")).drop("is_test"),
            "test": held.where(code == train_value)}
    for name, value in others.items():
        if value is None:
            sets[name] = every.where(code != train_value)
        elif isinstance(value, tuple):
            sets[name] = every.where(code == value[0])
        else:
            sets[name] = held.where(code == value)
    return sets


def transfer(df: DataFrame, column: str, train_value: int, others: dict[str, object],
             scenario: str, oversample: str = "none", fit_on: str = "train",
             **learner: object) -> DataFrame:
    """Trains on rows with one value of ``column`` and tests on the others.

    Rows are selected on the raw codes and scaled afterwards. ``oversample``
    grows the rare classes of the training set (``"train"``) or of training and
    test set (``"both"``).
    """
    raw = transfer_sets(df, column, train_value, others)
    fit = raw["train"].unionByName(raw["test"]) if fit_on == "all" else raw["train"]
    sets = dict(zip(raw, _scaled(fit, *raw.values())))
    grown = {"none": (), "train": ("train",), "both": ("train", "test")}[oversample]
    for name in grown:
        sets[name] = smote(sets[name], KEY, LABEL, features_of(sets[name]), seed=SEED)
    model = train(sets.pop("train"), **learner)
    return _evaluate(model, sets, scenario)


def by_ethnicity(df: DataFrame, **options: object) -> DataFrame:
    """Trains on group 0; tests on its test part, on test parts of groups 1
    and 3, and on all stays outside group 0."""
    return transfer(df, "ethnicity", 0, ETHNICITY_TESTS, "ethnicity", **options)


def by_system(df: DataFrame, **options: object) -> DataFrame:
    """Trains on one source system and tests on all stays of the other, both ways."""
    return side_by_side(df.sparkSession, [
        lambda a=a, b=b: transfer(df, "dbsource", a, {"other system": (b,)}, f"system {a} to {b}", **options)
        for a, b in ((0, 1), (1, 0))])


def set_classes(df: DataFrame) -> DataFrame:
    """Rows per class of every training and test set of the scenarios, before
    scaling and oversampling: ``scenario``, ``test_set``, label and ``n``."""
    ordered, df = _ordered(df), df.select(KEY, LABEL, "ethnicity", "dbsource")
    sets = {"ethnicity": transfer_sets(df, "ethnicity", 0, ETHNICITY_TESTS),
            "system 0 to 1": transfer_sets(df, "dbsource", 0, {"other system": (1,)}),
            "system 1 to 0": transfer_sets(df, "dbsource", 1, {"other system": (0,)})}
    for name, size in {"overall": 0.2, **{f"test size {size}": size for size in TEST_SIZES}}.items():
        sets[name] = dict(zip(("train", "test"), _cut(ordered, size)))
    rows = [part.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(scenario).alias("scenario"), F.lit(name).alias("test_set"), LABEL, "n")
        for scenario, parts in sets.items() for name, part in parts.items()]
    return reduce(DataFrame.unionByName, rows)
