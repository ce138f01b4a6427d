"""Model training with Spark ML: logistic regression, random forest, gradient-boosted trees.

The driver only orchestrates: every fit, CV fold and evaluation is a
distributed Spark job over one written table of all splits. A fit is one
(model, fold) and is made when first asked for (`Fits`): a coefficient table
waits for no tree, and only cross-validation fits folds. Model outputs are
turned into the long (model, customerID, label, p) table and scored by the
table operators of `evaluate`, so CV AUC, threshold tuning and holdout metrics
are the same code paths that are oracle-checked on deterministic scores.
"""

from __future__ import annotations

import hashlib
import math
import os
import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse import config as K
from lapse.functions.columns import round_half_up
from lapse.operators import evaluate as EV
from lapse.operators import split as SP
from lapse.operators import trees as TR
from lapse.session import materialize, materialize_parts, rename_table, shared_folder, table_exists

# Least rows a task of a fit or of scoring: a table smaller than this a partition is read in fewer partitions, because
# every round of boosting pays for its tasks, and a task that scores unpacks the whole model first.
ROWS_PER_TASK = 50_000


@dataclass(frozen=True)
class Profile:
    """Model sizes. `reference()` are the original settings; `quick()` is for checks on small data."""
    rf_trees: int = K.RF_TREES
    gbt_rounds: int = K.GBT_ROUNDS
    lr_max_iter: int = K.LOGISTIC_MAX_ITER
    cv_folds: int = K.CV_FOLDS
    parallelism: int = 8  # concurrent fits (CV folds and final models), as CrossValidator(parallelism=...)

    @staticmethod
    def reference() -> "Profile":
        return Profile()

    @staticmethod
    def quick() -> "Profile":
        return Profile(rf_trees=40, gbt_rounds=20, lr_max_iter=200, cv_folds=K.CV_FOLDS)


def build_pipelines(feature_cols: list[str], n_train: int, profile: Profile) -> dict[str, Pipeline]:
    """One Spark ML Pipeline per model, each starting from the raw numeric feature columns.

    Logistic: sklearn's C * sum(w*loss) + |b|^2/2 equals Spark's mean weighted
    loss + lambda/2 |b|^2 with lambda = 1 / (C * sum(w)); balanced weights sum to n.
    A forest over more rows than one task's is grown from histograms.
    """
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features_raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            regParam=1.0 / (K.LOGISTIC_C * max(n_train, 1)), elasticNetParam=0.0,
                            standardization=False, maxIter=profile.lr_max_iter, tol=1e-6)
    forest = RandomForestClassifier if n_train <= ROWS_PER_TASK else TR.HistogramForestClassifier
    rf = forest(featuresCol="features_raw", labelCol="label", weightCol="weight",
                numTrees=profile.rf_trees, maxDepth=K.RF_DEPTH, minInstancesPerNode=K.RF_MIN_LEAF,
                featureSubsetStrategy="sqrt", seed=K.SEED, maxMemoryInMB=256,
                cacheNodeIds=True, checkpointInterval=10)
    gbt = GBTClassifier(featuresCol="features_raw", labelCol="label", weightCol="gbt_weight",
                        maxIter=profile.gbt_rounds, maxDepth=K.GBT_DEPTH, stepSize=K.GBT_STEP,
                        subsamplingRate=K.GBT_SUBSAMPLE, featureSubsetStrategy=str(K.GBT_COLSAMPLE),
                        minInstancesPerNode=K.GBT_MIN_CHILD, seed=K.SEED, maxMemoryInMB=64, checkpointInterval=10)
    return {"logistic": Pipeline(stages=[asm, scaler, lr]),
            "random_forest": Pipeline(stages=[asm, rf]),
            "gbt": Pipeline(stages=[asm, gbt])}


def weighted(train: DataFrame, counts: dict[int, int] | None = None) -> DataFrame:
    """label (double), balanced `weight` n / (2 n_c), and `gbt_weight` = round(neg/pos, 2) on positives.

    `counts` are the rows of each class of `train`, counted here if not given; so the weights are constants, not a join."""
    if counts is None:
        counts = {r["c"]: r["n"] for r in train.groupBy(F.col("Churn").cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    balanced = {c: n / (2.0 * k) for c, k in counts.items() if k}
    positive = math.floor(counts.get(0, 0) / counts[1] * 100 + 0.5) / 100 if counts.get(1) else 1.0
    weight = F.lit(None).cast("double")
    for c, w in sorted(balanced.items()):
        weight = F.when(F.col("Churn") == c, w).otherwise(weight)
    return (train.withColumn("weight", weight).withColumn("label", F.col("Churn").cast("double"))
            .withColumn("gbt_weight", F.when(F.col("Churn") == 1, positive).otherwise(1.0)))


def long_scores(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """(model, customerID, label, p) from a fitted pipeline."""
    out = model.transform(df)
    return out.select(F.lit(name).alias("model"), K.ID_COL, F.col("Churn").cast("int").alias("label"),
                      vector_to_array("probability")[1].alias("p"))


class Fits:
    """The fits of a training run, each made once when first asked for.

    A fit is one (model, fold): the fold that is left out, or None for the final model. It is saved as a PipelineModel
    in the shared folder, under a fingerprint of the data, the split and the model's settings; a later run over the
    same data, in any session with the same shared folder, loads it. All fits read one written table; a fold's rows are
    a filter of it.
    """

    def __init__(self, features: DataFrame, split: DataFrame, feature_cols: list[str], profile: Profile | None = None) -> None:
        self.spark = features.sparkSession
        self.profile = profile or Profile.reference()
        self.feature_cols = feature_cols
        self.data = materialize(features.join(split.select(K.ID_COL, "split", "class_pos"), K.ID_COL)
                                .withColumn("fold", SP.fold_of(self.profile.cv_folds)), "training")
        self.train = self.data.where(F.col("split") == "train")
        sizes = self.data.groupBy("split", "fold", F.col("Churn").cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.sizes = {(r["fold"], r["c"]): r["n"] for r in sizes if r["split"] == "train"}  # folds x classes
        self.split_rows = {s: sum(r["n"] for r in sizes if r["split"] == s) for s in {r["split"] for r in sizes}}
        rows = self.data.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*self.data.columns).cast("decimal(38,0)")).alias("h")).first()
        self._data_print = f"{rows['n']}:{rows['h']}:{self.spark.version}:{','.join(feature_cols)}"
        self._models: dict[tuple[str, int | None], PipelineModel] = {}
        self._locks: dict[tuple[str, int | None], threading.Lock] = {}
        self._cut: dict[int | None, DataFrame] = {}
        self._guard = threading.Lock()
        self.made: list[tuple[str, int | None]] = []  # fits that this run trained itself

    @property
    def names(self) -> list[str]:
        return list(build_pipelines(self.feature_cols, 1, self.profile))

    def counts(self, fold: int | None) -> dict[int, int]:
        """Training rows of each class outside `fold`."""
        out: dict[int, int] = {}
        for (f, c), n in self.sizes.items():
            if f != fold:
                out[c] = out.get(c, 0) + n
        return out

    def rows(self, fold: int | None) -> DataFrame:
        """Weighted training rows outside `fold`: a fit of its own, with penalty and class weights of the rows it sees."""
        counts = self.counts(fold)
        own = self.train if fold is None else self.train.where(F.col("fold") != fold)
        # folds are fitted side by side: each takes its share of the cores, as a level's job pays for every task of it
        return weighted(own, counts).coalesce(self._tasks(sum(counts.values()), 1 if fold is None else self.profile.cv_folds))

    def cut_rows(self, fold: int | None) -> DataFrame:
        """What the fits of a fold read of `rows`, checkpointed once: a task of a fit carries the files behind each of its
        partitions and unpacks their plan, and boosting runs some 1,600 jobs of such tasks. Same rows, order and partitions."""
        with self._guard:
            lock = self._locks.setdefault(("rows", fold), threading.Lock())
        with lock:
            if fold not in self._cut:
                self._cut[fold] = self.rows(fold).select(*self.feature_cols, "label", "weight", "gbt_weight").checkpoint()
            return self._cut[fold]

    def _tasks(self, rows: int, beside: int = 1) -> int:
        """Tasks over `rows` rows: a core's each at most, of `beside` fits that run at once. One task more is a second wave
        in every job of a fit, since a task waits for the executor that holds its partition."""
        return max(1, min(math.ceil(self.spark.sparkContext.defaultParallelism / beside), math.ceil(rows / ROWS_PER_TASK)))

    def _path(self, name: str, fold: int | None, pipeline: Pipeline) -> str:
        settings = [type(s).__name__ for s in pipeline.getStages()] + [sorted((p.name, str(v)) for p, v in s.extractParamMap().items() if "Col" not in p.name) for s in pipeline.getStages()]
        mark = hashlib.sha256(f"{self._data_print}|{name}|{fold}|{settings}".encode()).hexdigest()
        return os.path.join(shared_folder(self.spark), "lapse-fits", mark)

    def model(self, name: str, fold: int | None = None) -> PipelineModel:
        key = (name, fold)
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            if key not in self._models:
                self._models[key] = self._load_or_fit(name, fold)
            return self._models[key]

    def _load_or_fit(self, name: str, fold: int | None) -> PipelineModel:
        pipeline = build_pipelines(self.feature_cols, sum(self.counts(fold).values()), self.profile)[name]
        path = self._path(name, fold, pipeline)
        if table_exists(self.spark, path):
            return PipelineModel.load(path)
        fitted = pipeline.fit(self.cut_rows(fold))
        self.made.append((name, fold))
        part = f"{path}-{uuid.uuid4().hex}"  # a run that dies while it writes leaves no half model under the name
        fitted.write().save(part)
        rename_table(self.spark, part, path)
        # Read back: a fitted model holds its training summary, and by that the session, which doesn't go to tasks once
        # the session has observed a write.
        return PipelineModel.load(path)

    def models(self, names: Iterable[str], folds: Iterable[int | None] = (None,)) -> dict[tuple[str, int | None], PipelineModel]:
        """Fits made concurrently from driver threads, the longest first; each is a series of Spark jobs."""
        order = {"gbt": 0, "random_forest": 1}
        keys = sorted(((n, k) for n in names for k in folds), key=lambda x: order.get(x[0], 2))
        with ThreadPoolExecutor(max_workers=max(1, self.profile.parallelism)) as pool:
            return dict(zip(keys, pool.map(lambda x: self.model(*x), keys), strict=True))

    def scores(self, name: str, split: str) -> DataFrame:
        """Long scores of the final model over the rows of a split."""
        return long_scores(self.model(name), self.split(split), name)

    def split(self, split: str) -> DataFrame:
        """The rows of a split, in few partitions: a task that scores unpacks the whole model first."""
        return self.data.where(F.col("split") == split).coalesce(self._tasks(self.split_rows.get(split, 0)))

    def fold(self, fold: int) -> DataFrame:
        """The training rows of a fold, in few partitions."""
        return self.train.where(F.col("fold") == fold).coalesce(self._tasks(sum(n for (f, _), n in self.sizes.items() if f == fold)))

    def cv_auc(self, names: Iterable[str]) -> DataFrame:
        """(model, cv_auc_mean, cv_auc_std): each fold scored by the fit that did not see it."""
        names, folds = list(names), range(self.profile.cv_folds)
        fits = self.models(names, folds)
        parts = [long_scores(fits[(n, k)], self.fold(k), f"{n}#{k}") for n in names for k in folds]
        return cv_summary(materialize_parts(parts, "cv-scores", self.profile.parallelism))

    def holdout(self, names: Iterable[str]) -> DataFrame:
        """(model, val_f1, threshold, test_auc, test_precision, test_recall, test_f1): the final fits alone."""
        names = list(names)
        self.models(names)
        val, test = (materialize_parts([self.scores(n, s) for n in names], f"{s}-scores", self.profile.parallelism) for s in ("val", "test"))
        tuned = EV.tune_threshold(val)
        metrics = EV.metrics_table(test, tuned)
        return materialize(tuned.join(metrics.drop("threshold"), "model").select(
            "model", "val_f1", "threshold", F.col("roc_auc").alias("test_auc"), F.col("precision").alias("test_precision"),
            F.col("recall").alias("test_recall"), F.col("f1").alias("test_f1")), "holdout")

    def results(self, names: Iterable[str] | None = None) -> DataFrame:
        """cv_auc_mean, cv_auc_std, val_f1, threshold, test_auc, test_precision, test_recall, test_f1 of each model."""
        names = self.names if names is None else list(names)
        self.models(names, [*range(self.profile.cv_folds), None])
        return self.cv_auc(names).join(self.holdout(names), "model").select(
            "model", "cv_auc_mean", "cv_auc_std", "val_f1", "threshold", "test_auc", "test_precision", "test_recall", "test_f1")


def cv_summary(scores: DataFrame) -> DataFrame:
    """(model, cv_auc_mean, cv_auc_std) of long scores whose model is named `<model>#<fold>`."""
    auc = EV.auc(scores).select(F.split("model", "#")[0].alias("model"), "auc")
    return auc.groupBy("model").agg(F.avg("auc").alias("cv_auc_mean"), F.stddev_pop("auc").alias("cv_auc_std"))


def train_all(features: DataFrame, split: DataFrame, feature_cols: list[str], profile: Profile | None = None,
              models: list[str] | None = None) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Fit every model and fold -> (final models, results table, long test scores)."""
    fits = Fits(features, split, feature_cols, profile)
    names = models or fits.names
    results = fits.results(names)
    return {n: fits.model(n) for n in names}, results, materialize_parts([fits.scores(n, "test") for n in names], "test-scores")


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def feature_importance(model: PipelineModel, feature_cols: list[str], name: str) -> DataFrame:
    """(feature, importance, model) from a tree model's featureImportances, highest first."""
    spark = _session()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v), name) for f, v in zip(feature_cols, imp)],
                               "feature string, importance double, model string")
    return df.orderBy(F.col("importance").desc(), "feature")


def logistic_coefficients(model: PipelineModel, feature_cols: list[str], top_n: int = K.TOP_FEATURES) -> DataFrame:
    """Signed coefficients (standardised space): the top_n by |coef|, then ordered by value."""
    spark = _session()
    coef = model.stages[-1].coefficients.toArray().tolist()
    df = spark.createDataFrame(list(zip(feature_cols, [float(c) for c in coef])), "feature string, coefficient double")
    return (df.orderBy(F.abs("coefficient").desc(), "feature").limit(top_n).orderBy("coefficient"))


def top_importance(importance: DataFrame, model: str, n: int = K.TOP_FEATURES) -> DataFrame:
    return importance.where(F.col("model") == model).orderBy(F.col("importance").desc(), "feature").limit(n)


def comparison_table(results: DataFrame) -> DataFrame:
    """Holdout metrics joined with 'mean ± std' CV text."""
    cv_text = F.format_string("%.4f ± %.4f", F.col("cv_auc_mean"), F.col("cv_auc_std"))
    return results.select("model", "threshold", "test_auc", "test_precision", "test_recall", "test_f1",
                          cv_text.alias("cv_auc")).orderBy(F.col("test_auc").desc(), "model")


def rounded_results(results: DataFrame) -> DataFrame:
    return results.select("model", *[round_half_up(c, 4).alias(c) for c in ("cv_auc_mean", "cv_auc_std", "val_f1")],
                          "threshold", "test_auc", "test_precision", "test_recall", "test_f1")
