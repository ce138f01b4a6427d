"""Evaluation as table operators over a long (model, label, p) table.

Nothing is collected: every metric is a group-by whose key space is bounded
(threshold grid index, distinct score, 2x2 cell), and every cumulative
quantity uses the distributed rank / running-sum helpers, so a table of
billions of scored rows is handled like the holdout of a few thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.config import DEFAULT_THRESHOLD, THRESHOLD_GRID
from lapse.operators.ordered import running_sums

_LO, _HI = THRESHOLD_GRID


def _grid_index(p: Column) -> Column:
    """Largest i in [lo, hi] with i/100 <= p (lo-1 when p < lo/100), exact in doubles."""
    c = F.floor(p * 100.0)
    i = (F.when((c + 1).cast("double") / 100.0 <= p, c + 1)
          .when(c.cast("double") / 100.0 > p, c - 1).otherwise(c))
    return F.greatest(F.least(i, F.lit(_HI)), F.lit(_LO - 1)).cast("int")


def _ratio(num: Column, den: Column) -> Column:
    """num / den with zero_division = 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def threshold_curve(scores: DataFrame) -> DataFrame:
    """(model, threshold, tp, fp, fn, precision, recall, f1) for thresholds i/100, i in the grid.

    Each row is bucketed by the grid index it reaches; one partial-aggregated
    group-by on (model, index, label) leaves <= 62 x 2 rows per model, and
    suffix sums over that tiny table give the counts at every threshold.
    """
    per = (scores.groupBy("model", _grid_index(F.col("p")).alias("i"))
           .agg(F.sum(F.col("label")).cast("long").alias("pos"),
                F.sum(1 - F.col("label")).cast("long").alias("neg")))
    totals = per.groupBy("model").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    grid = totals.select("model", "n_pos", "n_neg", F.explode(F.sequence(F.lit(_LO), F.lit(_HI))).alias("i"))
    w = Window.partitionBy("model").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # suffix sums over the bucket table (grid-sized per model)
    suffix = per.select("model", "i", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    # each grid threshold takes the suffix at the smallest bucket >= i
    w2 = Window.partitionBy("model").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = (grid.join(suffix, ["model", "i"], "full")
              .withColumn("tp", F.coalesce(F.last("tp", ignorenulls=True).over(w2), F.lit(0)))
              .withColumn("fp", F.coalesce(F.last("fp", ignorenulls=True).over(w2), F.lit(0)))
              .where(F.col("n_pos").isNotNull()))
    fn = F.col("n_pos") - F.col("tp")
    return filled.select(
        "model", (F.col("i").cast("double") / 100.0).alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), fn.cast("long").alias("fn"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn).alias("f1"))


def tune_threshold(scores: DataFrame) -> DataFrame:
    """(model, threshold, val_f1): the best F1 on the grid; the lowest threshold wins ties;
    (0.5, 0.0) when no threshold beats F1 = 0."""
    curve = threshold_curve(scores)
    w = Window.partitionBy("model").orderBy(F.col("f1").desc(), F.col("threshold").asc())
    best = curve.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select("model",
                       F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
                       F.when(F.col("f1") > 0, F.col("f1")).otherwise(F.lit(0.0)).alias("val_f1"))


def score_groups(scores: DataFrame) -> DataFrame:
    """(model, p, pos, neg) per distinct score: the key set never exceeds the row count."""
    return scores.groupBy("model", "p").agg(F.sum("label").cast("long").alias("pos"),
                                            F.sum(1 - F.col("label")).cast("long").alias("neg"))


def auc(scores: DataFrame) -> DataFrame:
    """Exact ROC AUC per model by the rank-sum formula with mid-ranks for ties.

    Rows are first aggregated to distinct scores (partial aggregation, so only
    (model, p, pos, neg) is shuffled, never the rows themselves). A running
    count along p gives the rows below each score; a tie group of n rows
    after c rows has doubled mid-rank 2c + n + 1, so the positive rank sum is
    an integer sum and the final value is one division.
    """
    g = score_groups(scores).withColumn("cnt", F.col("pos") + F.col("neg"))
    cum = running_sums(g, [F.col("model"), F.col("p")], ["cnt"], prefix="cum_", group_cols=["model"])
    # products of counts pass a bigint from some billions of rows on
    wide = lambda c: c.cast("decimal(19,0)")
    twice = cum.groupBy("model").agg(
        F.sum(wide(F.col("pos")) * wide(2 * (F.col("cum_cnt") - F.col("cnt")) + F.col("cnt") + 1)).alias("S2"),
        F.sum("pos").cast("long").alias("n_pos"), F.sum("neg").cast("long").alias("n_neg"))
    return twice.select(
        "model",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               (F.col("S2") - wide(F.col("n_pos")) * wide(F.col("n_pos") + 1)).cast("double")
               / (F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auc"),
        "n_pos", "n_neg")


def _cumulative_desc(scores: DataFrame) -> DataFrame:
    """Per distinct score, descending: cumulative positives/negatives with score >= p."""
    g = score_groups(scores)
    return running_sums(g, [F.col("model"), F.col("p").desc()], ["pos", "neg"], prefix="cum_", group_cols=["model"])


def roc_curve(scores: DataFrame) -> DataFrame:
    """(model, threshold, fpr, tpr): one row per distinct score plus the (0, 0) start (threshold NULL)."""
    cum = _cumulative_desc(scores)
    tot = scores.groupBy("model").agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg"))
    pts = cum.join(F.broadcast(tot), "model").select(
        "model", F.col("p").alias("threshold"), _ratio(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("n_pos")).alias("tpr"))
    start = tot.select("model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                       F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(scores: DataFrame) -> DataFrame:
    """(model, threshold, precision, recall) per distinct score plus the (recall 0, precision 1) end."""
    cum = _cumulative_desc(scores)
    tot = scores.groupBy("model").agg(F.sum("label").alias("n_pos"))
    pts = cum.join(F.broadcast(tot), "model").select(
        "model", F.col("p").alias("threshold"),
        _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("n_pos")).alias("recall"))
    end = tot.select("model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(scores: DataFrame) -> DataFrame:
    """AP = sum over distinct scores (desc) of (recall step) x precision: a step sum, not a trapezoid.
    Also the base rate (mean label) of the random classifier."""
    cum = _cumulative_desc(scores)
    tot = scores.groupBy("model").agg(F.sum("label").alias("n_pos"), F.avg("label").alias("base_rate"))
    prec = _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return (cum.join(F.broadcast(tot), "model")
            .groupBy("model", "base_rate")
            .agg(F.sum(F.when(F.col("n_pos") > 0, F.col("pos") / F.col("n_pos") * prec).otherwise(0.0))
                 .alias("average_precision")))


def predictions(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach pred = p >= threshold of the row's model (thresholds: model, threshold; tiny)."""
    return (scores.join(F.broadcast(thresholds.select("model", "threshold")), "model")
            .withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int")))


def confusion_matrix(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(model, actual, predicted, count) with all four cells, absent cells = 0."""
    pred = predictions(scores, thresholds)
    counts = pred.groupBy("model", F.col("label").alias("actual"), F.col("pred").alias("predicted")).count()
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted")) for a in (0, 1) for b in (0, 1)])
    grid = thresholds.select("model", F.explode(cells).alias("c")).select("model", "c.actual", "c.predicted")
    return (grid.join(counts, ["model", "actual", "predicted"], "left")
            .select("model", "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def metrics_table(scores: DataFrame, thresholds: DataFrame, digits: int = 4) -> DataFrame:
    """Per model: threshold, AUC, precision, recall, F1, accuracy (rounded half-up), best AUC first."""
    from lapse.functions.columns import round_half_up as rh
    pred = predictions(scores, thresholds)
    c = pred.groupBy("model", "threshold").agg(
        F.sum(F.col("pred") * F.col("label")).alias("tp"),
        F.sum(F.col("pred") * (1 - F.col("label"))).alias("fp"),
        F.sum((1 - F.col("pred")) * F.col("label")).alias("fn"),
        F.sum((1 - F.col("pred")) * (1 - F.col("label"))).alias("tn"))
    a = auc(scores).select("model", "auc")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return (c.join(a, "model").select(
        "model", "threshold", rh("auc", digits).alias("roc_auc"),
        rh(_ratio(tp, tp + fp), digits).alias("precision"), rh(_ratio(tp, tp + fn), digits).alias("recall"),
        rh(_ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
        rh(_ratio(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"))
        .orderBy(F.col("roc_auc").desc(), "model"))


def pick_best(results: DataFrame, by: str = "roc_auc") -> DataFrame:
    """The single best model row by `by` (desc), model name as tie-break."""
    return results.orderBy(F.col(by).desc(), F.col("model")).limit(1)
