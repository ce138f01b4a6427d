"""Similar customers: same segment, not self, MonthlyCharges within [lo*c, hi*c]
(inclusive), top k by revenue at risk (customerID breaks ties), for every customer.

A self-join on the segment would emit every pair inside a segment (a third of
all rows may share one). Instead this is an exact range top-k:

1. distinct (segment, charge) values get a dense index i per segment, and
   each value's window [lo*c, hi*c] is turned into index bounds, both by one
   distributed running count over the union of values and probes;
2. every block of 2^L consecutive values, for every level L, keeps its top
   k+1 rows (k+1 so that excluding self still leaves k); `row_number() <= k+1`
   is planned with a partial group limit before the shuffle;
3. the window is covered by at most two blocks per level (canonical dyadic
   cover), whose lists are joined in and cut to k+1 per window;
4. customers join their window's list, drop themselves and keep k.

Rows moved: O(N) to cut every value to k+1 rows, O(D k log D) for the blocks of
the D distinct values, and O(N k) for the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.config import ID_COL
from lapse.operators.ordered import running_sums
from lapse.session import materialize


def _order():
    return [F.col("revenue_at_risk").desc(), F.col(ID_COL).asc()]


def similar_customers(scored: DataFrame, k: int = 8, low: float = 0.85, high: float = 1.15,
                      segment_col: str = "segment_label", charge_col: str = "MonthlyCharges",
                      extra_cols: tuple[str, ...] = ("churn_probability",)) -> DataFrame:
    """(customerID, similar_id, similar_rank, <extra cols>, MonthlyCharges, revenue_at_risk) for every customer."""
    keep = k + 1
    rows = scored.select(ID_COL, F.col(segment_col).alias("seg"), F.col(charge_col).alias("c"), "revenue_at_risk",
                         *extra_cols)

    # 1. one running count over the distinct values and their window probes:
    #    a value's count within its segment is its dense index + 1; a probe
    #    at lo*c (sorted before equal values) counts the values strictly below
    #    it, a probe at hi*c (sorted after) the values at or below it.
    vals = rows.select("seg", "c").distinct()
    union = (vals.select("seg", F.col("c").alias("key"), F.lit(1).alias("typ"), F.col("c").alias("q"),
                         F.lit(1).alias("is_val"))
             .unionByName(vals.select("seg", (F.col("c") * F.lit(low)).alias("key"), F.lit(0).alias("typ"),
                                      F.col("c").alias("q"), F.lit(0).alias("is_val")))
             .unionByName(vals.select("seg", (F.col("c") * F.lit(high)).alias("key"), F.lit(2).alias("typ"),
                                      F.col("c").alias("q"), F.lit(0).alias("is_val"))))
    # read four times below: written once to the shared folder
    counted = materialize(running_sums(union, [F.col("seg"), F.col("key"), F.col("typ"), F.col("q")], ["is_val"],
                                       prefix="cum_", group_cols=["seg"]).select("seg", "typ", "q", "cum_is_val"),
                          "similar_bounds")
    idx = counted.where(F.col("typ") == 1).select("seg", F.col("q").alias("c"), (F.col("cum_is_val") - 1).alias("i"))
    max_d = (idx.select(F.max("i")).first()[0] or 0) + 1
    max_level = max(0, int(max_d - 1).bit_length())

    # 2. per value, then per level and block: the top k+1 rows. A block's top k+1
    #    lies inside the union of its values' top k+1, so only those (<= (k+1) D
    #    rows, not every customer) are expanded over the levels.
    #    The cut to k+1 per value runs before the index join, so a charge
    #    held by a third of all rows sends at most k+1 rows per map task.
    w0 = Window.partitionBy("seg", "c").orderBy(*_order())
    level0 = (rows.withColumn("_n", F.row_number().over(w0)).where(F.col("_n") <= keep).drop("_n")
              .join(idx, ["seg", "c"]))
    leveled = level0.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("lvl")) \
        .withColumn("blk", F.expr("shiftright(i, lvl)"))
    w = Window.partitionBy("seg", "lvl", "blk").orderBy(*_order())
    lists = (leveled.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
             .drop("_n", "i").withColumnRenamed("c", "nc"))

    # index bounds of each window (step 1)
    lo = counted.where(F.col("typ") == 0).select("seg", F.col("q").alias("c"), F.col("cum_is_val").alias("lo"))
    hi = counted.where(F.col("typ") == 2).select("seg", F.col("q").alias("c"), (F.col("cum_is_val") - 1).alias("hi"))
    windows = lo.join(hi, ["seg", "c"])

    # 3. canonical dyadic cover: <= 2 blocks per level whose parent is not inside the window
    lv = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("lvl"))
    b_left = F.expr("shiftright(lo + shiftleft(1L, lvl) - 1, lvl)")
    b_right = F.expr("shiftright(hi + 1, lvl) - 1")
    cover = (lv.select("seg", "c", "lo", "hi", "lvl", b_left.alias("bl"), b_right.alias("br"))
             .where(F.col("bl") <= F.col("br"))
             .select("seg", "c", "lo", "hi", "lvl", F.explode(F.array_distinct(F.array("bl", "br"))).alias("blk")))
    p_lo = F.expr("shiftleft(shiftright(blk, 1), lvl + 1)")
    p_hi = F.expr("shiftleft(shiftright(blk, 1) + 1, lvl + 1) - 1")
    cover = cover.where(~((p_lo >= F.col("lo")) & (p_hi <= F.col("hi")))).select("seg", "c", "lvl", "blk")

    cand = cover.join(lists, ["seg", "lvl", "blk"])
    wc = Window.partitionBy("seg", "c").orderBy(*_order())
    answers = (cand.withColumn("_n", F.row_number().over(wc)).where(F.col("_n") <= keep)
               .select("seg", "c", F.col(ID_COL).alias("similar_id"), F.col("nc").alias(charge_col), "revenue_at_risk",
                       *extra_cols))

    # 4. every customer takes its window's list, one ordered array of k+1 at most, and leaves itself out: one row a
    #    customer is joined, and nothing is shuffled by customer
    entry = F.struct((-F.col("revenue_at_risk")).alias("order"), "similar_id", *extra_cols, charge_col, "revenue_at_risk")
    listed = answers.groupBy("seg", "c").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    q = rows.select(F.col(ID_COL).alias("me"), "seg", "c").join(listed, ["seg", "c"])
    others = q.select("me", F.slice(F.filter("found", lambda x: x["similar_id"] != F.col("me")), 1, k).alias("others"))
    out = others.select("me", F.posexplode("others").alias("place", "x"))
    return out.select(F.col("me").alias(ID_COL), "x.similar_id", (F.col("place") + 1).alias("similar_rank"),
                      *(F.col(f"x.{c}").alias(c) for c in (*extra_cols, charge_col, "revenue_at_risk")))
