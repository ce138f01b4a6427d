"""Models given by their parameters: as Spark ML pipelines, and as SQL expressions.

A scorecard is a logistic model or an ensemble of binary trees: published
coefficients, a model fitted elsewhere, or a fitted pipeline read back (`read`).
`pipeline` makes the Spark ML model that scores it; `probability_sql` is the
same probability as an expression of CASE, exp and arithmetic, for engines that
run SQL alone. Both are bounded by the model's size, not by data.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lapse.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Logistic:
    """P = 1 / (1 + exp(-(intercept + sum of coefficient * (x - mean) / std)))."""
    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Leaf:
    """Value: the margin (boosted) or P(class 1) (forest); count: training rows."""
    value: float
    count: float


@dataclass(frozen=True)
class Split:
    """Rows with feature <= threshold go left."""
    feature: str
    threshold: float
    gain: float
    left: Split | Leaf
    right: Split | Leaf

    @property
    def count(self) -> float:
        return self.left.count + self.right.count

    @property
    def value(self) -> float:
        return (self.left.value * self.left.count + self.right.value * self.right.count) / self.count


Node = Split | Leaf


@dataclass(frozen=True)
class Forest:
    """P = mean of the trees' leaf probabilities."""
    features: tuple[str, ...]
    trees: tuple[Node, ...]


@dataclass(frozen=True)
class Boosted:
    """P = 1 / (1 + exp(-2 * sum of weight * leaf value))."""
    features: tuple[str, ...]
    trees: tuple[Node, ...]
    weights: tuple[float, ...]


Scorecard = Logistic | Forest | Boosted


# ---------------------------------------------------------------- SQL
def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _number(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def tree_sql(node: Node) -> str:
    if isinstance(node, Leaf):
        return _number(node.value)
    return f"case when {_quoted(node.feature)} <= {_number(node.threshold)} then {tree_sql(node.left)} else {tree_sql(node.right)} end"


def margin_sql(card: Logistic | Boosted) -> str:
    if isinstance(card, Logistic):
        terms = [f"{_number(c)} * (({_quoted(f)} - {_number(m)}) / {_number(s)})"
                 for f, m, s, c in zip(card.features, card.means, card.stds, card.coefficients, strict=True)]
        return f"({_number(card.intercept)} + {' + '.join(terms)})"
    return "(" + " + ".join(f"{_number(w)} * ({tree_sql(t)})" for t, w in zip(card.trees, card.weights, strict=True)) + ")"


def probability_sql(card: Scorecard, quote: str = '"') -> str:
    """The probability as an expression over the feature columns; `quote` is the engine's mark of identifiers."""
    if isinstance(card, Forest):
        out = f"(({' + '.join(tree_sql(t) for t in card.trees)}) / {_number(len(card.trees))})"
    else:
        scale = "" if isinstance(card, Logistic) else "2 * "
        out = f"(1 / (1 + exp(-({scale}{margin_sql(card)}))))"
    return out.replace('"', quote)


def features_of(node: Node) -> set[str]:
    return set() if isinstance(node, Leaf) else {node.feature} | features_of(node.left) | features_of(node.right)


def expected_sql(node: Node, known: frozenset[str]) -> str:
    """The tree's value for a row of which only `known` features are known: a split on another one is an average by counts."""
    if isinstance(node, Leaf):
        return _number(node.value)
    left, right = expected_sql(node.left, known), expected_sql(node.right, known)
    if node.feature in known:
        return f"(case when {_quoted(node.feature)} <= {_number(node.threshold)} then {left} else {right} end)"
    return f"(({_number(node.left.count)} * {left} + {_number(node.right.count)} * {right}) / {_number(node.count)})"


def shapley_sql(card: Boosted) -> dict[str, str]:
    """Shapley value of each feature of the margin, by its definition over all subsets of a tree's features: for small trees."""
    parts: dict[str, list[str]] = {}
    for tree, w in zip(card.trees, card.weights, strict=True):
        own = sorted(features_of(tree))
        for f in own:
            rest = [x for x in own if x != f]
            for k in range(len(rest) + 1):
                share = factorial(k) * factorial(len(own) - 1 - k) / factorial(len(own))
                for subset in combinations(rest, k):
                    gain = f"{expected_sql(tree, frozenset((*subset, f)))} - {expected_sql(tree, frozenset(subset))}"
                    parts.setdefault(f, []).append(f"{_number(w * share)} * ({gain})")
    return {f: "(" + " + ".join(p) + ")" for f, p in parts.items()}


# ---------------------------------------------------------------- Spark ML
def _doubles(spark: SparkSession, xs: Sequence[float]):
    gateway = spark.sparkContext._gateway
    out = gateway.new_array(gateway.jvm.double, len(xs))
    for i, x in enumerate(xs):
        out[i] = float(x)
    return out


def _java_node(spark: SparkSession, node: Node, at: dict[str, int], forest: bool):
    """A node of Spark ML: class counts as statistics in a forest's, (count, sum, sum of squares) in a regression tree's."""
    jvm = spark._jvm.org.apache.spark
    n = node.count
    stats = [n - n * node.value, n * node.value] if forest else [n, n * node.value, n * node.value**2]
    impurity = jvm.mllib.tree.impurity
    calculator = (impurity.GiniCalculator if forest else impurity.VarianceCalculator)(_doubles(spark, stats), int(n))
    prediction = float(node.value > 0.5) if forest else float(node.value)
    if isinstance(node, Leaf):
        return jvm.ml.tree.LeafNode(prediction, 0.0, calculator)
    left, right = (_java_node(spark, x, at, forest) for x in (node.left, node.right))
    split = jvm.ml.tree.ContinuousSplit(at[node.feature], float(node.threshold))
    return jvm.ml.tree.InternalNode(prediction, 0.0, float(node.gain), left, right, split, calculator)


def pipeline(spark: SparkSession, card: Scorecard) -> PipelineModel:
    """The Spark ML pipeline of a scorecard, with the stages that `train` fits."""
    jvm, gateway = spark._jvm.org.apache.spark, spark.sparkContext._gateway
    assembler = VectorAssembler(inputCols=list(card.features), outputCol="features_raw", handleInvalid="keep")
    uid = lambda kind: f"{kind}_{uuid.uuid4().hex[:12]}"
    vectors = jvm.ml.linalg.Vectors
    if isinstance(card, Logistic):
        scaler = jvm.ml.feature.StandardScalerModel(uid("StandardScaler"), vectors.dense(_doubles(spark, card.stds)),
                                                    vectors.dense(_doubles(spark, card.means)))
        for name, value in (("withMean", True), ("withStd", True), ("inputCol", "features_raw"), ("outputCol", "features")):
            scaler.set(scaler.getParam(name), value)
        model = jvm.ml.classification.LogisticRegressionModel(uid("LogisticRegression"), vectors.dense(_doubles(spark, card.coefficients)), float(card.intercept))
        model.setFeaturesCol("features")
        return PipelineModel([assembler, _wrapped(StandardScalerModel, scaler), _wrapped(LogisticRegressionModel, model)])
    at = {f: i for i, f in enumerate(card.features)}
    forest, width = isinstance(card, Forest), len(card.features)
    kind = jvm.ml.classification.DecisionTreeClassificationModel if forest else jvm.ml.regression.DecisionTreeRegressionModel
    trees = gateway.new_array(kind, len(card.trees))
    built = {}  # equal trees are one object
    for i, t in enumerate(card.trees):
        if t not in built:
            built[t] = kind(uid("Tree"), _java_node(spark, t, at, forest), width, *([2] if forest else []))
        trees[i] = built[t]
    if forest:
        model = jvm.ml.classification.RandomForestClassificationModel(uid("RandomForestClassifier"), trees, width, 2)
        model.set(model.getParam("numTrees"), len(card.trees))  # loading a saved forest checks it
    else:
        model = jvm.ml.classification.GBTClassificationModel(uid("GBTClassifier"), trees, _doubles(spark, card.weights), width, 2)
    model.setFeaturesCol("features_raw")
    return PipelineModel([assembler, _wrapped(RandomForestClassificationModel if forest else GBTClassificationModel, model)])


def _wrapped(kind, java):
    model = kind(java)
    model._transfer_params_from_java()
    return model


# ---------------------------------------------------------------- reading fitted pipelines
def read(model: PipelineModel, spark: SparkSession) -> Scorecard:
    """The scorecard of a fitted pipeline of `train`: its parameters, read from the stages or the saved node table."""
    features, last = tuple(model.stages[0].getInputCols()), model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        scaler = model.stages[1]
        numbers = lambda v: tuple(float(x) for x in v.toArray())
        # A constant column has no spread; the scaler then gives 0.
        stds, coefficients = numbers(scaler.std), numbers(last.coefficients)
        return Logistic(features, numbers(scaler.mean), tuple(s or 1.0 for s in stds),
                        tuple(c if s else 0.0 for c, s in zip(coefficients, stds, strict=True)), float(last.intercept))
    path = os.path.join(ensure_checkpoint_dir(spark), f"scorecard-{uuid.uuid4().hex}")
    last.write().save(path)
    rows = spark.read.parquet(os.path.join(path, "data")).select(F.col("treeID").alias("t"), "nodeData.*").collect()  # the model's nodes
    forest, by_tree = isinstance(last, RandomForestClassificationModel), {}
    for r in rows:
        by_tree.setdefault(r["t"], {})[r["id"]] = r

    def node(own: dict, i: int) -> Node:
        r = own[i]
        if r["leftChild"] < 0:
            stats = list(r["impurityStats"])
            return Leaf(stats[1] / sum(stats) if forest else float(r["prediction"]), float(sum(stats) if forest else stats[0]))
        split = r["split"]
        return Split(features[split["featureIndex"]], float(split["leftCategoriesOrThreshold"][0]), float(r["gain"]),
                     node(own, r["leftChild"]), node(own, r["rightChild"]))

    trees = tuple(node(by_tree[t], 0) for t in sorted(by_tree))
    return Forest(features, trees) if forest else Boosted(features, trees, tuple(float(w) for w in last.treeWeights))
