"""Medallion-style layers over the fixture: raw -> cleaned -> features -> scored.

cleaned, features, split and scored are written once per session as Parquet
tables in the shared checkpoint folder (as the batch pipeline writes its layers),
so every query starts from a short lineage with column pruning and pushdown. All
four are bucketed and sorted by customerID: their joins on it need no exchange.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession

from lapse.config import HIGH_VALUE_PERCENTILE, ID_COL
from lapse.operators import clean as C
from lapse.operators import features as FE
from lapse.operators import scoring as S
from lapse.operators import segments as SG
from lapse.operators.clean import quantiles
from lapse.session import bucketed, materialize
from lapse.sources import fixture

TEST_THRESHOLD = 0.54

_LAYERS: dict = {}
_LOCK = threading.RLock()


def forget(sf_dir: str | None = None) -> None:
    """Build the layers of a data folder (or of all) anew when they are next read."""
    with _LOCK:
        for key in [k for k in _LAYERS if sf_dir is None or k[2] == sf_dir]:
            del _LAYERS[key]


def _layer(fn):
    """Build a layer once per (session, data folder, args) and reuse it: the tables of written layers stay in the shared
    folder until `forget`, which a change of the data folder's files calls for."""
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args, **kwargs):
        key = (fn.__name__, spark.sparkContext.applicationId, sf_dir, args, tuple(sorted(kwargs.items())))
        with _LOCK:
            if key not in _LAYERS:
                _LAYERS[key] = fn(spark, sf_dir, *args, **kwargs)
            return _LAYERS[key]
    return wrapper


@_layer
def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.customers(spark, sf_dir)


@_layer
def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL pack's `customers`: numeric TotalCharges, Churn still Yes/No."""
    return materialize(C.sql_view(raw(spark, sf_dir)), "sqlview")


@_layer
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(C.clean(raw(spark, sf_dir)), "cleaned", ID_COL)


@_layer
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(FE.engineer(cleaned(spark, sf_dir)), "features", ID_COL)


@_layer
def scored(spark: SparkSession, sf_dir: str, threshold: float = TEST_THRESHOLD) -> DataFrame:
    """features + deterministic fixture scores -> prediction, rar, rank, segments."""
    feats = features(spark, sf_dir)
    s = S.score(feats, fixture.scores(spark, sf_dir), threshold, "fixture", rank=False)
    # every feature row has exactly one fixture score (same customer keys), so the
    # median charge is taken from the features layer: one column scan, not a second join
    median = quantiles(feats, "MonthlyCharges", [HIGH_VALUE_PERCENTILE])[0]
    return bucketed(S.risk_rank(SG.assign_segments(s, median_charge=median)), "scored", ID_COL)


@_layer
def scored_by_segment(spark: SparkSession, sf_dir: str, threshold: float = TEST_THRESHOLD) -> DataFrame:
    """The scored layer with one folder a segment: reports of one segment read that folder alone."""
    from lapse.sources import files as IO
    path = IO.scratch_path(spark, "scored-by-segment")
    IO.write_scored(scored(spark, sf_dir, threshold), path)
    return IO.read_layer(spark, path, "scoring")


@_layer
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows (Churn 0/1) plus tenure_band and service_count, readable categories kept."""
    from pyspark.sql import functions as F
    from lapse.functions.columns import tenure_band
    return cleaned(spark, sf_dir).select("*", tenure_band("tenure").alias("tenure_band"),
                                         FE.service_count().alias("service_count"))


DISPLAY_SCORE_COLS = ["churn_probability", "churn_predicted", "revenue_at_risk", "risk_rank", "scoring_model",
                      "risk_tier", "value_tier", "is_high_value", "segment_label", "segment_priority",
                      "recommended_action", "segment_color", "service_count", "tenure_band", "is_autopay",
                      "is_longterm_contract", "avg_monthly_revenue", "charges_delta", "clv_estimate"]


@_layer
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable cleaned rows left-joined with whichever score columns exist (one shuffle on the id)."""
    from lapse.functions.columns import tenure_band
    sc = scored(spark, sf_dir)
    avail = [c for c in DISPLAY_SCORE_COLS if c in sc.columns]
    out = cleaned(spark, sf_dir).join(sc.select("customerID", *avail), "customerID", "left")
    if "tenure_band" not in avail:
        out = out.withColumn("tenure_band", tenure_band("tenure"))
    return out


@_layer
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customerID, Churn, split, class_pos): the deterministic stratified split of the cleaned layer."""
    from lapse.operators import split as SP
    return bucketed(SP.stratified_split(cleaned(spark, sf_dir)), "split", ID_COL)


@_layer
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, customerID, label, p, split) for the deterministic scorers."""
    return materialize(fixture.model_scores(spark, sf_dir).join(
        split(spark, sf_dir).select("customerID", "split"), "customerID"), "eval_scores")
