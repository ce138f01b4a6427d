"""Deterministic stratified split, CV folds, class weights and the seeded sample.

Row order inside a class is md5(customerID || '#<seed>') (customerID breaks
ties), so the split is reproducible on any cluster layout. Positions inside a
class come from the distributed global rank; class offsets are a table with
one row per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.config import CV_FOLDS, ID_COL, SEED, TARGET_COL
from lapse.functions.columns import round_half_up
from lapse.operators.ordered import global_rank, top_n


def seeded_key(seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(ID_COL), F.lit(f"#{seed}")))


def class_positions(df: DataFrame, label: str = TARGET_COL, seed: int = SEED) -> DataFrame:
    """(customerID, label, class_pos, class_n): 1-based position inside the class."""
    keyed = df.select(ID_COL, F.col(label).alias("_label"), seeded_key(seed).alias("_k"))
    ranked = global_rank(keyed, [F.col("_label"), F.col("_k"), F.col(ID_COL)], "_r")
    counts = keyed.groupBy("_label").agg(F.count(F.lit(1)).alias("class_n"))
    w = Window.orderBy("_label").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_label", "class_n", F.coalesce(F.sum("class_n").over(w), F.lit(0)).alias("_off"))
    return (ranked.join(F.broadcast(offs), "_label")
            .select(ID_COL, F.col("_label").alias(label), (F.col("_r") - F.col("_off")).alias("class_pos"), "class_n"))


def stratified_split(df: DataFrame, train_pct: int = 70, val_pct: int = 15, label: str = TARGET_COL,
                     seed: int = SEED) -> DataFrame:
    """(customerID, label, split, class_pos): per class the first floor(train%) rows in seeded order
    are train, the next up to floor((train+val)%) are val, the rest test (integer arithmetic)."""
    pos = class_positions(df, label, seed)
    split = (F.when(F.col("class_pos") * 100 <= F.col("class_n") * train_pct, "train")
              .when(F.col("class_pos") * 100 <= F.col("class_n") * (train_pct + val_pct), "val")
              .otherwise("test"))
    return pos.select(ID_COL, label, split.alias("split"), "class_pos")


def fold_of(k: int = CV_FOLDS) -> Column:
    """Stratified fold of a train row: (class_pos - 1) mod k."""
    return ((F.col("class_pos") - 1) % k).cast("int")


def cv_folds(split: DataFrame, k: int = CV_FOLDS) -> DataFrame:
    """Stratified k folds over the train rows."""
    return split.where(F.col("split") == "train").select(ID_COL, fold_of(k).alias("fold"))


def class_weights(train: DataFrame, label: str = TARGET_COL) -> DataFrame:
    """Balanced weights n / (2 n_c) per class, plus round(neg/pos, 2) for boosted trees."""
    # one pass over the rows; the totals come from the two-row result
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    both = Window.partitionBy()
    of = lambda c: F.sum(F.when(F.col(label) == c, F.col("n_c")).otherwise(0)).over(both)
    total = F.sum("n_c").over(both)
    return counts.select(label, "n_c", (total.cast("double") / (F.lit(2.0) * F.col("n_c"))).alias("weight"),
                         round_half_up(of(0).cast("double") / F.nullif(of(1), F.lit(0)), 2).alias("scale_pos_weight"))


def seeded_sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Exactly min(n, rows) rows, stable across runs: the n smallest seeded keys (a top-k)."""
    return top_n(df, [seeded_key(seed), F.col(ID_COL)], n, ID_COL)
