"""Registered queries that need models.

Each is registered twice: over models fitted here, with the original sizes
(rows-only checks: a fit has no SQL form), and, named `known_...`, over models of
known parameters, checked against SQL. A query fits the models that it reads and
no others; fits are shared by the queries of a session and saved in the shared
folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lapse import config as K
from lapse.functions.columns import round_half_up
from lapse.operators import explain as EX
from lapse.operators import features as FE
from lapse.operators import scorecard as SC
from lapse.operators import scoring as S
from lapse.operators import serving as SV
from lapse.operators import train as T
from lapse.plans import known_models as KM
from lapse.plans import layers as L
from lapse.plans import queries_eval as QE
from lapse.plans.registry import register
from lapse.session import materialize, materialize_parts
from lapse.sources import files as IO
from lapse.streaming.scoring import score_backlog

_LOCK = threading.Lock()
_MEMO: dict = {}


class Known(T.Fits):
    """A training run whose models are given: every fold's is the same one."""

    def __init__(self, features: DataFrame, split: DataFrame, feature_cols: list[str], profile: T.Profile, cards: dict[str, SC.Scorecard]) -> None:
        super().__init__(features, split, feature_cols, profile)
        self.built = {name: SC.pipeline(self.spark, card) for name, card in cards.items()}

    def model(self, name: str, fold: int | None = None) -> PipelineModel:
        return self.built[name]


class Trained:
    """The training run of a session over a data folder: every part is made when a query first reads it."""

    def __init__(self, spark: SparkSession, sf: str, profile: T.Profile, cards: dict[str, SC.Scorecard] | None = None):
        self.features = L.features(spark, sf)
        self.feature_cols = FE.model_columns(self.features) if cards is None else list(KM.FEATURES)
        self.fits = T.Fits(self.features, L.split(spark, sf), self.feature_cols, profile) if cards is None else Known(
            self.features, L.split(spark, sf), self.feature_cols, profile, cards)

    def model(self, name: str):
        return self.fits.model(name)

    @cached_property
    def holdout(self) -> DataFrame:
        return self.fits.holdout(self.fits.names)

    @cached_property
    def results(self) -> DataFrame:
        """Cross-validation beside the holdout metrics: the only part that fits every fold."""
        self.fits.models(self.fits.names, [*range(self.fits.profile.cv_folds), None])
        return materialize(self.fits.cv_auc(self.fits.names).join(self.holdout, "model").select(
            "model", "cv_auc_mean", "cv_auc_std", "val_f1", "threshold", "test_auc", "test_precision", "test_recall", "test_f1"),
            "model-results")

    @cached_property
    def best(self) -> tuple[str, float]:
        """(name, threshold) of the model with the highest test AUC; it needs no fold."""
        row = self.holdout.orderBy(F.col("test_auc").desc(), "model").first()
        return row["model"], float(row["threshold"])

    @cached_property
    def median_charge(self) -> float:
        return self.features.select(F.median("MonthlyCharges")).first()[0]

    @cached_property
    def scored(self) -> DataFrame:
        """Every customer scored with the best model and segmented, written once."""
        name, threshold = self.best
        # scoring is row for row, so the median charge of the features layer is the scored one
        return S.score_once(self.model(name), self.features, threshold, name, self.median_charge)


def trained(spark: SparkSession, sf: str, profile: T.Profile | None = None) -> Trained:
    return _memo(spark, sf, profile or T.Profile.reference(), None)


def known(spark: SparkSession, sf: str) -> Trained:
    return _memo(spark, sf, T.Profile.reference(), KM.CARDS)


def _memo(spark: SparkSession, sf: str, profile: T.Profile, cards: dict[str, SC.Scorecard] | None) -> Trained:
    key = (spark.sparkContext.applicationId, sf, profile, cards is None)
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = Trained(spark, sf, profile, cards)
        return _MEMO[key]


_MODEL_QUERIES: dict[str, Callable[[Trained, SparkSession, str], DataFrame]] = {}


def _model_query(name: str):
    def deco(fn):
        _MODEL_QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- scores of the test split, results, comparison
for _name, _model in (("f03_logistic_test_scores", "logistic"), ("f04_random_forest_test_scores", "random_forest"),
                      ("f05_gbt_test_scores", "gbt")):
    _model_query(_name)(lambda t, spark, sf, model=_model: t.fits.scores(model, "test"))

_model_query("f06_cv_auc")(lambda t, spark, sf: t.fits.cv_auc(t.fits.names))
_model_query("f20_train_all")(lambda t, spark, sf: T.rounded_results(t.results))
_model_query("a06_model_results")(lambda t, spark, sf: t.results)
_model_query("f19_comparison_table")(lambda t, spark, sf: T.comparison_table(t.results))


@_model_query("a06_model_results_json")
def _results_json(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    path = IO.scratch_path(spark, "model-results")
    IO.write_model_results(t.results, path)
    return IO.read_model_results(spark, path)


@_model_query("f10_best_model_by_f1")
def _best_by_f1(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    """The model of the highest test F1, by the final fits; only its own folds are fitted for its CV columns."""
    best = t.holdout.orderBy(F.col("test_f1").desc(), "model").limit(1)
    return t.fits.cv_auc([best.first()["model"]]).join(best, "model").select(
        "model", "cv_auc_mean", "cv_auc_std", "val_f1", "threshold", "test_auc", "test_precision", "test_recall", "test_f1")


@_model_query("a08_model_roundtrip")
def _models_roundtrip(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    """Save every model, load back only those present, score the test split with each."""
    root = IO.scratch_path(spark, "models")
    IO.save_models({name: m for (name, _), m in t.fits.models(t.fits.names).items()}, root)
    loaded = sorted(IO.load_models(spark, root).items())
    return materialize_parts([T.long_scores(m, t.fits.split("test"), name) for name, m in loaded], "roundtrip-scores")


# ---------------------------------------------------------------- importances and attribution
@_model_query("f14_native_importance")
def _native(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    t.fits.models(["gbt", "random_forest"])
    return (T.feature_importance(t.model("random_forest"), t.feature_cols, "Random Forest")
            .unionByName(T.feature_importance(t.model("gbt"), t.feature_cols, "Gradient Boosted Trees")))


@_model_query("f15_tree_shap")
def _tree_shap(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    return EX.tree_shap_mean_abs(t.model("gbt").stages[-1], t.features, t.feature_cols, "SHAP")


_model_query("f15_linear_shap")(lambda t, spark, sf: EX.linear_shap_mean_abs(t.model("logistic"), t.features, t.feature_cols))
_model_query("f17_logistic_coefficients")(lambda t, spark, sf: T.logistic_coefficients(t.model("logistic"), t.feature_cols))
_model_query("f18_top_shap_features")(lambda t, spark, sf: T.top_importance(_tree_shap(t, spark, sf), "SHAP"))


@_model_query("a07_importance_table")
def _importance_table(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    """The importance blocks written as one table and read back."""
    path = IO.scratch_path(spark, "importance")
    IO.write_importance([_native(t, spark, sf), _tree_shap(t, spark, sf)], path)
    return IO.read_importance(spark, path)


# ---------------------------------------------------------------- scoring with the best model
_model_query("g01_model_churn_probability")(lambda t, spark, sf: t.scored.select(K.ID_COL, "churn_probability", "scoring_model"))


@_model_query("g05_model_score_all")
def _score_all(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    own = [K.ID_COL, "churn_probability", "churn_predicted", "revenue_at_risk", "segment_label"]
    return S.risk_rank(t.scored.select(own)).select(*own[:4], "risk_rank", "segment_label")


@_model_query("g25_score_new")
def _arrivals(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    """New arrivals = the raw-shaped rows of the table, scored with frozen training constants."""
    name, threshold = t.best
    return SV.score_arrivals(L.raw(spark, sf).drop("Churn"), t.model(name), threshold, t.median_charge, t.feature_cols, name)


@_model_query("g25_stream_score")
def _stream(t: Trained, spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals written as Parquet files, scored by an availableNow stream into a Parquet sink."""
    name, threshold = t.best
    src = IO.scratch_path(spark, "arrivals")
    L.raw(spark, sf).drop("Churn").write.parquet(src)
    return score_backlog(spark, src, IO.scratch_path(spark, "scored-sink"), IO.scratch_path(spark, "stream-ckpt"),
                         t.model(name), threshold, t.median_charge, t.feature_cols, name)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles at nine digits: engines differ in the last bits of exp and of sums."""
    return df.select(*(round_half_up(f.name, 9).alias(f.name) if isinstance(f.dataType, Ty.DoubleType) else F.col(f.name)
                       for f in df.schema.fields))


_ORACLES = KM.oracles(QE._SPLIT, QE._CURVE, QE._AUC)
#: These fit every fold; they are registered behind those that need final fits alone.
_WITH_FOLDS = ["f10_best_model_by_f1", "f06_cv_auc", "f20_train_all", "a06_model_results", "f19_comparison_table", "a06_model_results_json"]
for _name in [*(n for n in _MODEL_QUERIES if n not in _WITH_FOLDS), *_WITH_FOLDS]:
    _fn = _MODEL_QUERIES[_name]
    register(_name)(lambda spark, sf, fn=_fn: fn(trained(spark, sf), spark, sf))
    register(f"known_{_name}", _ORACLES[_name])(lambda spark, sf, fn=_fn: _rounded(fn(known(spark, sf), spark, sf)))
