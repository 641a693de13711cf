"""Modelling (family F) and model-based scoring.

Training uses the point-in-time feature rows (each row sees only earlier
executions of its test), split by label with exact class counts, then a
Spark ML ``Pipeline`` (assembler, scaler, classifier) fitted on the train
part only. Scoring is ``PipelineModel.transform`` over one row per test.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from suitewise.operators.features import FEATURE_NAMES, KEY, NEW_TEST_DEFAULTS
from suitewise.operators.ordered import global_rank
from suitewise.operators.risk import classification_metrics, roc_auc
from suitewise.session import ensure_checkpoint_dir

ALGORITHMS = ("random_forest", "gradient_boosting", "logistic_regression")


# ---------------------------------------------------------------- F1 scaler

def fit_population_scaler(df: DataFrame, cols: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """F1 fit: one row of mean and population std per column (one global aggregation)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_population_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str] = FEATURE_NAMES,
                            digits: int | None = None) -> DataFrame:
    """F1 transform: (x - mean) / std, a zero std divides by 1.

    The one-row statistics table is joined on a constant key and broadcast;
    its size is one row by construction.
    """
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
    out = []
    for c in cols:
        std = F.col(f"{c}__std")
        v = (F.col(c).cast("double") - F.col(f"{c}__mean")) / F.when(std == 0, F.lit(1.0)).otherwise(std)
        out.append((F.round(v, digits) if digits is not None else v).alias(c))
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *out)


# ---------------------------------------------------------------- F2 split, F12 folds

def _label_ranks(df: DataFrame, label: str, seed: int, id_col: str) -> DataFrame:
    """1-based position of each row inside its label, in a seeded hash order (distributed): that of
    the MD5 of ``seed:id``, which any engine can recompute."""
    h = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    ranked = global_rank(h, [F.col(label).asc(), F.col("_h").asc(), F.col(id_col).asc()], "_pos")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(label, "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    j = ranked.join(F.broadcast(before), label)
    return j.withColumn("_rank", F.col("_pos") - F.col("_off")).drop("_h", "_pos", "_off")


def stratified_split(df: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     id_col: str = "exec_id") -> DataFrame:
    """adds ``split`` = 'test' for the first ceil(share x class size) rows of each label
    in a seeded hash order, else 'train'. Exact class counts, no driver shuffle."""
    r = _label_ranks(df, label, seed, id_col)
    is_test = F.col("_rank") <= F.ceil(F.col("_n") * F.lit(test_size))
    return r.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_rank", "_n")


def assign_folds(df: DataFrame, k: int = 5, label: str = "label", seed: int = 42,
                 id_col: str = "exec_id") -> DataFrame:
    """F12 folds: fold = (rank inside label - 1) mod k, stratified."""
    r = _label_ranks(df, label, seed, id_col)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def split_report(split: DataFrame, label: str = "label") -> DataFrame:
    """train rows, test rows, failure rate."""
    return split.agg(F.count_if(F.col("split") == "train").alias("train_rows"),
                     F.count_if(F.col("split") == "test").alias("test_rows"),
                     (F.count_if(F.col(label) == 1).cast("double") / F.count(F.lit(1)).cast("double"))
                     .alias("failure_rate"))


# ---------------------------------------------------------------- F4..F8

def make_classifier(algorithm: str, n_rows: int | None = None, **params):
    """classifier by name; unknown names raise."""
    if algorithm == "random_forest":
        return RandomForestClassifier(
            numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 10),
            featureSubsetStrategy="sqrt", seed=params.get("random_state", 42), maxBins=64,
            cacheNodeIds=True, checkpointInterval=10, labelCol="label", featuresCol="features")
    if algorithm == "gradient_boosting":
        return GBTClassifier(maxIter=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 5),
                             stepSize=0.1, seed=params.get("random_state", 42), maxBins=64,
                             checkpointInterval=10, labelCol="label", featuresCol="features")
    if algorithm == "logistic_regression":
        reg = 1.0 / n_rows if n_rows else 0.0
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False,
                                  maxIter=1000, labelCol="label", featuresCol="features")
    if algorithm == "linear_svc":  # gives a class, no probabilities
        return LinearSVC(maxIter=params.get("max_iter", 100), regParam=params.get("reg_param", 0.01),
                         labelCol="label", featuresCol="features")
    raise ValueError(f"Unknown algorithm: {algorithm}")


def make_pipeline(algorithm: str, n_rows: int | None = None, **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="raw_features",
                                handleInvalid="error")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[assembler, scaler, make_classifier(algorithm, n_rows, **params)])


def _prepare(rows: DataFrame) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in FEATURE_NAMES]
    return rows.select(KEY, "exec_id", *cols, F.col("label").cast("double").alias("label")).dropna()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there.

    Iterative fitting re-reads its input many times; a reliable checkpoint
    cuts the lineage so neither an iteration nor a lost executor recomputes
    the feature windows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_A_TASK = 125_000  # at most, in training: a forest of 100 trees reads some 1,500 bytes a row in each round
FOLDS_AT_ONCE = 3  # a fit is many short jobs, which leave cores idle between them
MIN_ROWS_A_TASK = 20_000  # smaller parts cost more in scheduling than they save


def training_tasks(n: int, cores: int) -> int:
    """Parts for ``n`` training rows: their size is bounded, and every core has one when there is work for it."""
    return max(math.ceil(n / ROWS_A_TASK), min(cores, n // MIN_ROWS_A_TASK), 1)


def materialised_for_training(rows: DataFrame, mark: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``mark(prepared rows)`` (a split, folds), materialised in even parts.

    The rows are written before ``mark``, which goes over them several times. What leaves ``mark`` is cut by
    compressed bytes and by range, so a part could hold any number of rows, and every iteration of a fit runs
    with as many tasks as there are parts.
    """
    prepared = materialise(_prepare(rows))
    tasks = training_tasks(prepared.count(), rows.sparkSession.sparkContext.defaultParallelism)
    marked = mark(prepared)
    return materialise(marked.repartition(tasks) if tasks > 1 else marked)


def fit(rows: DataFrame, algorithm: str = "random_forest", **params) -> PipelineModel:
    """F8 fit on prepared rows (the train split), which the caller has materialised."""
    n = rows.count() if algorithm == "logistic_regression" else None
    return make_pipeline(algorithm, n, **params).fit(rows)


def failure_probability(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """P(failed) per row; the class itself when the model gives no probabilities; an untrained one raises.

    Every row is scored: a missing feature takes the default of a test without history (E21), or 0.
    """
    if not isinstance(model, PipelineModel):
        raise ValueError("Model not trained: fit or load one first")
    scored = model.transform(features.fillna({c: NEW_TEST_DEFAULTS.get(c, 0) for c in FEATURE_NAMES}))
    if "probability" in scored.columns:
        p = vector_to_array(F.col("probability"))[1]
    else:
        p = F.col("prediction")
    return scored.select(*[c for c in features.columns if c not in FEATURE_NAMES],
                         p.alias("failure_probability"), F.col("prediction").cast("bigint").alias("prediction"))


def train(rows: DataFrame, algorithm: str = "random_forest", test_size: float = 0.2, seed: int = 42,
          **params) -> tuple[PipelineModel, DataFrame]:
    """F8: split, fit on train, evaluate both parts (F9, F10). Returns (model, metrics)."""
    split = materialised_for_training(rows, lambda p: stratified_split(p, "label", test_size, seed))
    model = fit(split.where(F.col("split") == "train"), algorithm, **params)
    scored = failure_probability(model, split).select("split", "label", "prediction", "failure_probability")
    return model, evaluate(materialise(scored))  # scored once: the metrics go over the scores several times


def evaluate(scored: DataFrame) -> DataFrame:
    """F9 + F10 per split."""
    s = scored.select("split", F.col("label").cast("bigint").alias("label"), "prediction",
                      F.col("failure_probability").alias("score"))
    m = classification_metrics(s, by=["split"])
    aucs = None
    for part in ("train", "test"):
        a = roc_auc(s.where(F.col("split") == part)).select(F.lit(part).alias("split"), "roc_auc")
        aucs = a if aucs is None else aucs.unionByName(a)
    return m.join(aucs, "split", "left")


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """importances by feature name, largest first (13 values)."""
    clf = model.stages[-1]
    if not hasattr(clf, "featureImportances"):
        return spark.createDataFrame([], "feature string, importance double, rank int")
    imp = clf.featureImportances.toArray().tolist()
    rows = sorted(zip(FEATURE_NAMES, imp), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def cross_validate(rows: DataFrame, algorithm: str = "logistic_regression", k: int = 5, seed: int = 42,
                   **params) -> DataFrame:
    """stratified k folds; mean and population std of accuracy, precision, recall, F1."""
    prepared = materialised_for_training(rows, lambda p: assign_folds(p, k, "label", seed))
    # each fold goes over the rows several times: they are kept as columns, the ids left out
    kept = prepared.select(*FEATURE_NAMES, "label", "fold").persist(StorageLevel.MEMORY_AND_DISK)

    def score(f: int) -> DataFrame:
        model = fit(kept.where(F.col("fold") != f), algorithm, **params)
        scored = failure_probability(model, kept.where(F.col("fold") == f))
        m = classification_metrics(scored.select(F.col("label").cast("bigint").alias("label"), "prediction"))
        return materialise(m.select(F.lit(f).alias("fold"), "accuracy", "precision", "recall", "f1"))

    at_once = min(k, FOLDS_AT_ONCE)
    try:
        kept.count()  # one pass fills the cache before several folds read it
        with ThreadPool(at_once) as pool:
            folds = pool.map(inheritable_thread_target(rows.sparkSession)(score), range(k), chunksize=1)
    finally:
        kept.unpersist()
    per_fold = reduce(DataFrame.unionByName, folds)
    aggs = []
    for c in ("accuracy", "precision", "recall", "f1"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return per_fold.agg(*aggs)


def save_model(model: PipelineModel, path: str) -> None:
    """Spark ML writer (stages, scaler statistics and feature order travel together)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load; a missing model raises a clear error."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        # a reader of a missing folder raises one of several types; any other fault is passed on
        if not any(x in str(e) for x in ("does not exist", "PATH_NOT_FOUND", "FileNotFound")):
            raise
        raise FileNotFoundError(f"Trained model not found at {path}; train the model first") from e


def positive_share(n: int, share: float) -> int:
    """Test rows of a class of size n (kept in one place for tests)."""
    return int(math.ceil(n * share))
