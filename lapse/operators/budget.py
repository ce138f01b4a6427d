"""Budget-constrained targeting: ROI ranking, allocation, impact curve, scenario grids.

All targeting orders by roi_score desc with customerID as the tie-break, so
results are deterministic. ROI is a positive multiple of MonthlyCharges *
churn_probability for every (save rate, months, cost), so ONE ranking serves
every scenario of a grid: the grid is answered from prefix sums of that
ranking instead of re-sorting the table per scenario.

Top-n selection is `ordered.top_n`: one plan at every n and table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.config import (DEFAULT_BUDGET, DEFAULT_INTERVENTION_COST, DEFAULT_LIFETIME_MONTHS, DEFAULT_SAVE_RATE,
                          ID_COL, IMPACT_MAX_BUDGET, IMPACT_STEP)
from lapse.operators.ordered import global_rank, top_n



def _roi_order():
    return [F.col("roi_score").desc(), F.col(ID_COL).asc()]


def compute_roi(df: DataFrame, save_rate: float = DEFAULT_SAVE_RATE,
                intervention_cost: float = DEFAULT_INTERVENTION_COST,
                lifetime_months: int = DEFAULT_LIFETIME_MONTHS) -> DataFrame:
    """expected_save_value = charge * p * save_rate * months; roi_score = esv / cost."""
    esv = F.col("MonthlyCharges") * F.col("churn_probability") * F.lit(float(save_rate)) * F.lit(float(lifetime_months))
    return (df.withColumn("expected_save_value", esv)
              .withColumn("roi_score", F.col("expected_save_value") / F.lit(float(intervention_cost))))


def roi_ranked(df: DataFrame, save_rate: float = DEFAULT_SAVE_RATE,
               intervention_cost: float = DEFAULT_INTERVENTION_COST,
               lifetime_months: int = DEFAULT_LIFETIME_MONTHS) -> DataFrame:
    """compute_roi + unique roi_rank over the whole table (distributed global rank)."""
    roi = compute_roi(df, save_rate, intervention_cost, lifetime_months)
    return global_rank(roi, _roi_order(), "roi_rank").withColumn("roi_rank", F.col("roi_rank").cast("int"))


def top_n_by_roi(roi: DataFrame, n: int) -> DataFrame:
    """The n best rows by ROI with roi_rank 1..n."""
    if n <= 0:
        return roi.limit(0).withColumn("roi_rank", F.lit(0))
    # at most n rows: the window runs over a bounded table
    return top_n(roi, _roi_order(), n, ID_COL).withColumn("roi_rank", F.row_number().over(Window.orderBy(*_roi_order())))


def _max_targets(budget: float, cost: float) -> int:
    return int(budget // cost) if cost > 0 else 0


def allocate_budget(scored: DataFrame, budget: float = DEFAULT_BUDGET,
                    intervention_cost: float = DEFAULT_INTERVENTION_COST,
                    save_rate: float = DEFAULT_SAVE_RATE, segment_filter: str | None = None,
                    lifetime_months: int = DEFAULT_LIFETIME_MONTHS) -> tuple[DataFrame, DataFrame]:
    """Greedy targeting within a budget -> (targets, one-row summary).

    do_nothing_revenue_loss is the revenue at risk of the whole table, even
    with a segment filter (kept as in the original). pct_risk_covered divides a
    `months`-horizon saving by a monthly loss (original units);
    pct_risk_covered_horizon applies the horizon to the loss as well.
    """
    working = scored if not segment_filter else scored.where(F.col("segment_label") == segment_filter)
    n = _max_targets(budget, intervention_cost)
    roi = compute_roi(working, save_rate, intervention_cost, lifetime_months)
    targets = top_n_by_roi(roi, n).withColumn("cumulative_cost", F.col("roi_rank") * F.lit(float(intervention_cost)))
    picked = targets.agg(F.count(F.lit(1)).alias("n_targeted"),
                         F.coalesce(F.sum("expected_save_value"), F.lit(0.0)).alias("expected_revenue_saved"))
    # one scalar subquery, referenced as a column afterwards
    loss = picked.select("*", scored.select(F.sum("revenue_at_risk")).scalar().alias("do_nothing_revenue_loss"),
                         (F.col("n_targeted") * F.lit(float(intervention_cost))).alias("total_cost"))
    saved, dn, cost_total = F.col("expected_revenue_saved"), F.col("do_nothing_revenue_loss"), F.col("total_cost")
    summary = loss.select(
        F.lit(float(budget)).alias("budget"), "n_targeted", "total_cost", "expected_revenue_saved",
        "do_nothing_revenue_loss",
        F.when(cost_total > 0, saved / cost_total).otherwise(0.0).alias("roi_multiple"),
        F.when(dn > 0, saved / dn).otherwise(0.0).alias("pct_risk_covered"),
        F.when(dn > 0, saved / (dn * float(lifetime_months))).otherwise(0.0).alias("pct_risk_covered_horizon"))
    return targets, summary


def _prefix_at(ranked: DataFrame, ns: list[int], value: str) -> DataFrame:
    """(n, sum of `value` over ranks <= n, rows) for each n in `ns` in one pass.

    Each row is assigned to the smallest requested n >= its rank (a CASE over
    the sorted, bounded list of n), aggregated, then a running sum over at most
    len(ns) rows gives the answer for every n.
    """
    spark = ranked.sparkSession
    targets = sorted(set(int(x) for x in ns if x > 0))
    grid = spark.createDataFrame([(n,) for n in sorted(set(int(x) for x in ns))], "n int")
    if not targets:
        return grid.select("n", F.lit(0.0).alias("top_sum"), F.lit(0).cast("long").alias("top_rows"))
    bucket = None
    for t in targets:
        cond = F.col("roi_rank") <= t
        bucket = F.when(cond, t) if bucket is None else bucket.when(cond, t)
    per = (ranked.where(F.col("roi_rank") <= targets[-1]).groupBy(bucket.alias("n"))
           .agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c")))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(per, "n", "left").na.fill({"_s": 0.0, "_c": 0})
    return joined.select("n", F.sum("_s").over(w).alias("top_sum"), F.sum("_c").over(w).alias("top_rows"))


def impact_curve(scored: DataFrame, max_budget: float = IMPACT_MAX_BUDGET, step: float = IMPACT_STEP,
                 intervention_cost: float = DEFAULT_INTERVENTION_COST, save_rate: float = DEFAULT_SAVE_RATE,
                 lifetime_months: int = DEFAULT_LIFETIME_MONTHS, segment_filter: str | None = None) -> DataFrame:
    """(budget, expected_revenue_saved, n_customers) for budget = 0, step, ..., max_budget."""
    spark = scored.sparkSession
    working = scored if not segment_filter else scored.where(F.col("segment_label") == segment_filter)
    budgets = [k * step for k in range(int(max_budget // step) + 1)]
    ns = [_max_targets(b, intervention_cost) for b in budgets]
    roi = compute_roi(working, save_rate, intervention_cost, lifetime_months)
    ranked = top_n_by_roi(roi, max(ns))
    sums = _prefix_at(ranked, ns, "expected_save_value")
    grid = spark.createDataFrame([(float(b), n) for b, n in zip(budgets, ns)], "budget double, n int")
    return (grid.join(sums, "n", "left")
            .select("budget", F.coalesce("top_sum", F.lit(0.0)).alias("expected_revenue_saved"),
                    F.col("n").alias("n_customers")))


def budget_scenarios(scored: DataFrame, budgets: list[float], costs: list[float] | None = None,
                     save_rates: list[float] | None = None, months: list[int] | None = None,
                     segment_filter: str | None = None) -> DataFrame:
    """Allocation summary for every (budget, cost, save rate, months) in one pass over one ranking."""
    spark = scored.sparkSession
    costs = costs or [DEFAULT_INTERVENTION_COST]
    save_rates = save_rates or [DEFAULT_SAVE_RATE]
    months = months or [DEFAULT_LIFETIME_MONTHS]
    working = scored if not segment_filter else scored.where(F.col("segment_label") == segment_filter)
    rows = [(float(b), float(c), float(r), int(m), _max_targets(b, c))
            for b in budgets for c in costs for r in save_rates for m in months]
    base = working.withColumn("_base", F.col("MonthlyCharges") * F.col("churn_probability"))
    # roi order == _base order for every positive (rate, months, cost)
    roi = base.withColumn("roi_score", F.col("_base"))
    ranked = top_n_by_roi(roi, max(r[4] for r in rows))
    sums = _prefix_at(ranked, [r[4] for r in rows], "_base")
    grid = spark.createDataFrame(rows, "budget double, intervention_cost double, save_rate double, "
                                       "lifetime_months int, n int")
    saved = F.coalesce(F.col("top_sum"), F.lit(0.0)) * F.col("save_rate") * F.col("lifetime_months")
    n_t = F.coalesce(F.col("top_rows"), F.lit(0))
    cost_total = n_t * F.col("intervention_cost")
    joined = grid.join(sums, "n", "left").select(
        "*", scored.select(F.sum("revenue_at_risk")).scalar().alias("_dn"))
    do_nothing = F.col("_dn")
    return (joined.select(
        "budget", "intervention_cost", "save_rate", "lifetime_months", n_t.cast("long").alias("n_targeted"),
        cost_total.alias("total_cost"), saved.alias("expected_revenue_saved"),
        do_nothing.alias("do_nothing_revenue_loss"),
        F.when(cost_total > 0, saved / cost_total).otherwise(0.0).alias("roi_multiple"),
        F.when(do_nothing > 0, saved / do_nothing).otherwise(0.0).alias("pct_risk_covered")))


def segment_roi(scored: DataFrame, save_rate: float = DEFAULT_SAVE_RATE,
                intervention_cost: float = DEFAULT_INTERVENTION_COST,
                lifetime_months: int = DEFAULT_LIFETIME_MONTHS) -> DataFrame:
    roi = compute_roi(scored, save_rate, intervention_cost, lifetime_months)
    return roi.groupBy("segment_label").agg(F.avg("roi_score").alias("roi_score")).orderBy(F.col("roi_score").desc())


def act_vs_nothing(summary: DataFrame, lifetime_months: int = DEFAULT_LIFETIME_MONTHS) -> DataFrame:
    """Both comparisons: the monthly bar (monthly loss minus a horizon saving, original units)
    and the annualised one (loss x months minus the saving)."""
    return summary.select(
        "budget", "expected_revenue_saved",
        F.col("do_nothing_revenue_loss").alias("do_nothing_monthly"),
        (F.col("do_nothing_revenue_loss") - F.col("expected_revenue_saved")).alias("with_budget_monthly_bar"),
        (F.col("do_nothing_revenue_loss") * float(lifetime_months)).alias("do_nothing_horizon"),
        (F.col("do_nothing_revenue_loss") * float(lifetime_months) - F.col("expected_revenue_saved"))
        .alias("with_budget_horizon"))


def business_summary(scored: DataFrame, top_segment: str = "Save Immediately") -> DataFrame:
    """Totals, at-risk share and the top segment's share of exposure (one global aggregate)."""
    top = F.col("segment_label") == top_segment
    return scored.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("Churn").alias("actual_churn_rate"),
        F.sum("churn_predicted").cast("long").alias("predicted_at_risk"),
        (F.sum("churn_predicted") / F.count(F.lit(1))).alias("predicted_at_risk_share"),
        F.sum("revenue_at_risk").alias("monthly_revenue_at_risk"),
        F.sum(F.when(top, F.col("revenue_at_risk")).otherwise(0.0)).alias("top_segment_revenue_at_risk"),
    ).withColumn("top_segment_share", F.col("top_segment_revenue_at_risk") / F.col("monthly_revenue_at_risk"))
