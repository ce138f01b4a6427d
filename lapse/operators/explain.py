"""Feature attribution: mean |SHAP| per feature.

* Logistic model: linear SHAP in the standardised space, phi_j = beta_j * z_j
  (the training mean of z is 0), computed with column expressions.
* Tree ensembles (GBT margin): exact path-dependent TreeSHAP (Lundberg et al.,
  2018). The fitted trees are read back from the saved model's Parquet node
  table (size bounded by trees x nodes, not by data) and broadcast as leaves;
  each Arrow batch is explained as one matrix, in the partitions the rows come
  in, and the mean |phi| is a Spark aggregation over the whole table.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.config import ID_COL
from lapse.session import ensure_checkpoint_dir


# ---------------------------------------------------------------- linear
def linear_shap_mean_abs(model, sample: DataFrame, feature_cols: list[str], name: str = "SHAP-linear") -> DataFrame:
    """mean |beta_j * z_j| over `sample`; model = assembler -> scaler -> logistic pipeline."""
    coef = [float(c) for c in model.stages[-1].coefficients.toArray()]
    scaled = model.stages[1].transform(model.stages[0].transform(sample))
    z = vector_to_array(F.col("features"))
    wide = scaled.select(*[F.avg(F.abs(z[i] * F.lit(coef[i]))).alias(f"f{i}") for i in range(len(feature_cols))])
    pairs = ", ".join(f"'{c}', f{i}" for i, c in enumerate(feature_cols))
    return (wide.selectExpr(f"stack({len(feature_cols)}, {pairs}) as (feature, importance)")
            .withColumn("model", F.lit(name)).orderBy(F.col("importance").desc(), "feature"))


# ---------------------------------------------------------------- trees
class Tree:
    """Array form of one regression tree: children (-1 = leaf), split feature/threshold, value, cover."""

    def __init__(self, left, right, feature, threshold, value, cover):
        self.left, self.right = np.asarray(left), np.asarray(right)
        self.feature, self.threshold = np.asarray(feature), np.asarray(threshold, dtype=float)
        self.value, self.cover = np.asarray(value, dtype=float), np.asarray(cover, dtype=float)

    def predict(self, x: np.ndarray) -> float:
        j = 0
        while self.left[j] >= 0:
            j = self.left[j] if x[self.feature[j]] <= self.threshold[j] else self.right[j]
        return float(self.value[j])

    def expected_value(self) -> float:
        leaves = self.left < 0
        return float((self.value[leaves] * self.cover[leaves]).sum() / self.cover[0])


class Leaf:
    """A leaf as the interval that its path leaves to each feature on it, and the leaf's SHAP values for every subset
    of those features whose interval a row meets (path-dependent: a feature left out passes with the share of cover)."""

    def __init__(self, features: list[int], low: list[float], high: list[float], share: list[float], value: float) -> None:
        m = len(features)
        self.features, self.low, self.high = np.array(features), np.array(low), np.array(high)
        self.bits = 1 << np.arange(m)
        # phi[met, i] = value * (o_i - z_i) * sum over sizes s of coalitions without i: s! (m-1-s)! / m! * c_s, where
        # c_s is the coefficient of t^s in the product of (z_j + o_j t) over the other features
        weight = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
        self.phi = np.zeros((1 << m, m))
        for met in range(1 << m):
            o = [met >> j & 1 for j in range(m)]
            for i in range(m):
                c = np.ones(1)
                for j in range(m):
                    if j != i:
                        c = np.convolve(c, [share[j], o[j]])
                self.phi[met, i] = value * (o[i] - share[i]) * float(np.dot(c, weight))


def leaves(tree: Tree) -> list[Leaf]:
    """The leaves of a tree with a split; the order of splits on a path does not matter for SHAP, their product does."""
    out: list[Leaf] = []
    todo = [(0, {})]
    while todo:
        j, path = todo.pop()
        if tree.left[j] < 0:
            if path:
                f = sorted(path)
                out.append(Leaf(f, [path[d][0] for d in f], [path[d][1] for d in f], [path[d][2] for d in f], float(tree.value[j])))
            continue
        d, t = int(tree.feature[j]), float(tree.threshold[j])
        low, high, share = path.get(d, (-np.inf, np.inf, 1.0))
        for child, interval in ((tree.left[j], (low, min(high, t))), (tree.right[j], (max(low, t), high))):
            todo.append((int(child), {**path, d: (*interval, share * float(tree.cover[child] / tree.cover[j]))}))
    return out


def shap_matrix(forest: list[tuple[float, list[Leaf]]], xs: np.ndarray) -> np.ndarray:
    """SHAP values (rows x features) of a weighted ensemble: each leaf looks its values up by which of its intervals
    a row meets, for all rows at once. Features are rows of the working arrays, and each of the ensemble's few thresholds
    is compared with its feature once."""
    columns, phi = np.ascontiguousarray(xs.T), np.zeros(xs.shape[::-1])
    above: dict[tuple[int, float], np.ndarray] = {}
    below: dict[tuple[int, float], np.ndarray] = {}
    found = np.empty(len(xs))

    def meets(f: int, low: float, high: float) -> np.ndarray:
        if (f, low) not in above:
            above[f, low] = columns[f] > low
        if (f, high) not in below:
            below[f, high] = columns[f] <= high
        return below[f, high] if low == -np.inf else above[f, low] if high == np.inf else above[f, low] & below[f, high]

    for weight, own in forest:
        for leaf in own:
            met = np.zeros(len(xs), dtype=np.intp)
            for bit, f, low, high in zip(leaf.bits, leaf.features, leaf.low, leaf.high, strict=True):
                met += meets(f, low, high) * bit
            for f, values in zip(leaf.features, (weight * leaf.phi).T, strict=True):
                phi[f] += np.take(values, met, out=found, mode="clip")  # `met` is in range; other modes buffer
    return np.ascontiguousarray(phi.T)


def ensemble_trees(model, spark: SparkSession) -> tuple[list[Tree], list[float]]:
    """Read a fitted tree-ensemble stage back as arrays via its saved Parquet node table."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, f"tree-model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data"))
    has_tree_id = "treeID" in nodes.columns
    cols = [F.col("treeID") if has_tree_id else F.lit(0).alias("treeID"),
            "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            "nodeData.rawCount", "nodeData.impurityStats", "nodeData.split.featureIndex",
            "nodeData.split.leftCategoriesOrThreshold"]
    # bounded by model size (trees x nodes), not by data
    pdf = nodes.select(*cols).toPandas()
    weights = list(getattr(model, "treeWeights", [1.0]))
    trees = []
    for tid in sorted(pdf["treeID"].unique()):
        t = pdf[pdf["treeID"] == tid].sort_values("id")
        n = int(t["id"].max()) + 1
        left, right = np.full(n, -1), np.full(n, -1)
        feat, thr = np.zeros(n, dtype=int), np.zeros(n)
        val, cov = np.zeros(n), np.zeros(n)
        for r in t.itertuples(index=False):
            i = int(r.id)
            left[i], right[i] = int(r.leftChild), int(r.rightChild)
            feat[i] = int(r.featureIndex) if left[i] >= 0 else 0
            lc = r.leftCategoriesOrThreshold
            thr[i] = float(lc[0]) if left[i] >= 0 and lc is not None and len(lc) else 0.0
            val[i] = float(r.prediction)
            stats = r.impurityStats
            cov[i] = float(stats[0]) if stats is not None and len(stats) else float(r.rawCount)
        trees.append(Tree(left, right, feat, thr, val, cov))
    return trees, weights


def tree_shap_values(rows: DataFrame, trees: list[Tree], weights: list[float], feature_cols: list[str]) -> DataFrame:
    """(customerID, phi array<double>) for every row: margin-space SHAP of the weighted ensemble."""
    n_feat = len(feature_cols)
    wide = rows.select(ID_COL, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(feature_cols)])

    shared = rows.sparkSession.sparkContext.broadcast([(w, leaves(t)) for t, w in zip(trees, weights)])  # model-sized

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs = pdf[[f"x{i}" for i in range(n_feat)]].to_numpy(dtype=float)
            yield pd.DataFrame({ID_COL: pdf[ID_COL], "phi": list(shap_matrix(shared.value, xs))})

    return wide.mapInPandas(explain, f"{ID_COL} string, phi array<double>")


def tree_shap_mean_abs(model, rows: DataFrame, feature_cols: list[str], name: str = "SHAP") -> DataFrame:
    """mean |phi_j| per feature over all `rows` for a fitted tree-ensemble stage."""
    trees, weights = ensemble_trees(model, rows.sparkSession)
    phi = tree_shap_values(rows, trees, weights, feature_cols)
    names = F.array(*[F.lit(c) for c in feature_cols])
    long = phi.select(F.posexplode("phi").alias("i", "v")).select(names[F.col("i")].alias("feature"), "v")
    return (long.groupBy("feature").agg(F.avg(F.abs("v")).alias("importance"))
            .withColumn("model", F.lit(name)).orderBy(F.col("importance").desc(), "feature"))
