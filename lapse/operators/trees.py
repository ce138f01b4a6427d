"""Forests over many rows, grown from histograms of binned features.

Spark ML updates one statistic at a time for each (row, tree, feature), in memory as large as all trees' open nodes. Here
a task counts its rows tree by tree with array operations. All trees grow a level a job: tasks send each tree's sums by
open node, feature and bin, and no rows; the trees are dealt out by a shuffle, their sums added and split there; the
driver gets the chosen splits, as large as the model.

Cut points, split rules, pruning and the model that comes out are Spark ML's. The random draws (bootstrap, features of a
node) follow from the seed, the tree, the level and the partition, so that a task that runs again draws the same; they
are not those of Spark ML's generators, which can only be drawn one after the other.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import scorecard as SC
from lapse.session import drop_tables, ensure_checkpoint_dir

CUT_ROWS = 10_000  # rows that the cut points of features are taken from, as in Spark ML
_EPS = np.finfo(float).eps


# ---------------------------------------------------------------- binning
def cut_points(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Ascending thresholds of a feature: all midpoints of its values, or `most` of them at equal shares of the weight."""
    v, at = np.unique(values + 0.0, return_inverse=True)  # -0.0 counts as 0.0
    if len(v) - 1 <= most:
        return (v[:-1] + v[1:]) / 2
    counts = np.cumsum(np.bincount(at, weights))
    stride = counts[-1] / (most + 1)
    out, target = [], stride
    for i in range(1, len(v)):
        if abs(counts[i - 1] - target) < abs(counts[i] - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out)


def _cuts(rows: DataFrame, n: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Cut points of each feature, from all rows or, of a larger table, from about max(max_bins^2, CUT_ROWS) of them."""
    share = max(max_bins**2, CUT_ROWS) / max(n, 1)
    t = (rows if share >= 1 else rows.sample(False, share, seed)).select("x", "w").toArrow()
    w = t.column("w").to_numpy()
    x = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(w), -1)
    return [cut_points(x[:, f], w, max_bins - 1) for f in range(x.shape[1])]


def _read(batches: Iterable[pa.RecordBatch], cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of a row's features, label, weight) of a task's rows. A value is in the bin of the first threshold that it
    does not exceed."""
    bins, y, w = [np.empty((0, len(cuts)), np.uint8)], [np.empty(0)], [np.empty(0)]
    for b in batches:
        x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(cuts))
        bins.append(np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1).astype(np.uint8))
        y.append(b.column("y").to_numpy())
        w.append(b.column("w").to_numpy())
    return np.concatenate(bins), np.concatenate(y), np.concatenate(w)


def features_a_node(strategy: str, width: int) -> int:
    if strategy in ("all", "sqrt"):
        return width if strategy == "all" else math.ceil(math.sqrt(width))
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


def _subsets(nodes: int, width: int, take: int, *mark: int) -> np.ndarray:
    """Nodes x `take` features, ascending, drawn without replacement."""
    if take >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.sort(np.argsort(np.random.default_rng(mark).random((nodes, width)), 1)[:, :take], 1)


# ---------------------------------------------------------------- splits
def gini(s: np.ndarray) -> np.ndarray:
    """Impurity of (rows, weight of class 0, weight of class 1)."""
    total = s[..., 1] + s[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1.0 - (s[..., 1] / total) ** 2 - (s[..., 2] / total) ** 2, 0.0)


def best_splits(sums: np.ndarray, bins: np.ndarray, min_rows: int, min_gain: float) -> tuple[np.ndarray, ...]:
    """(feature's place, cut, gain, sums left, sums right) of each node; the gain is 0 where no split is allowed.

    `sums` are nodes x features x bins x (rows, weight of class 0, of class 1); `bins` counts the bins of each node's
    features. The first of equal splits is taken."""
    nodes, width, most, _ = sums.shape
    left = np.cumsum(sums, 2)
    total = left[:, :, -1:, :]
    right = total - left
    lw, rw = (s[..., 1] + s[..., 2] for s in (left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gini(total) - lw / (lw + rw) * gini(left) - rw / (lw + rw) * gini(right)
    allowed = (np.arange(most) < bins[:, :, None] - 1) & (left[..., 0] >= min_rows) & (right[..., 0] >= min_rows) & (gain >= min_gain)
    gain = np.where(allowed, gain, 0.0).reshape(nodes, width * most)
    best = np.argmax(gain, 1)
    each, place, cut = np.arange(nodes), best // most, best % most
    return place, cut, gain[each, best], left[each, place, cut], right[each, place, cut]


@dataclass
class Grown:
    """Trees by heap number: the root is 1, the children of i are 2 i (at most the cut) and 2 i + 1."""
    feature: np.ndarray  # -1 where a node is not split
    cut: np.ndarray
    gain: np.ndarray
    sums: np.ndarray  # rows, weight of class 0, of class 1

    @staticmethod
    def empty(trees: int, depth: int) -> Grown:
        shape = (trees, 2 ** (depth + 1))
        return Grown(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros((*shape, 3)))


def node_table(grown: Grown, cuts: list[np.ndarray]) -> pa.Table:
    """The nodes as Spark ML saves them, children behind their parents; siblings that are leaves of one prediction are
    one leaf, as there."""
    out: dict[str, list] = {k: [] for k in ("treeID", "id", "prediction", "impurity", "stats", "rawCount", "gain", "left", "right", "feature", "threshold")}
    rows, stats = grown.sums[..., 0], grown.sums[..., 1:]
    prediction, impurity = (stats[..., 1] > stats[..., 0]).astype(float), gini(grown.sums)
    width = grown.feature.shape[1]
    for t in range(len(grown.feature)):
        split = grown.feature[t] >= 0
        for i in np.flatnonzero(split)[::-1]:
            split[i] = bool(split[2 * i] or split[2 * i + 1] or prediction[t, 2 * i] != prediction[t, 2 * i + 1])
        there = np.zeros(width, bool)
        there[1] = True
        for i in np.flatnonzero(split):  # a node of a pruned part is never there
            there[2 * i] = there[2 * i + 1] = there[i]
        at = np.flatnonzero(there)
        number, inner = np.cumsum(there) - 1, split[at]
        f = np.where(inner, grown.feature[t, at], -1)
        child = np.where(inner, 2 * at, 0)
        out["treeID"].append(np.full(len(at), t, np.int32))
        out["id"].append(np.arange(len(at), dtype=np.int32))
        for name, values in (("prediction", prediction), ("impurity", impurity), ("stats", stats)):
            out[name].append(values[t, at])
        out["rawCount"].append(rows[t, at].astype(np.int64))
        out["gain"].append(np.where(inner, grown.gain[t, at], -1.0))
        out["left"].append(np.where(inner, number[child], -1).astype(np.int32))
        out["right"].append(np.where(inner, number[child + 1 * inner], -1).astype(np.int32))
        out["feature"].append(f.astype(np.int32))
        out["threshold"].append(np.array([cuts[k][c] if k >= 0 else 0.0 for k, c in zip(f, grown.cut[t, at], strict=True)]))
    col = {k: np.concatenate(v) for k, v in out.items()}
    n, inner = len(col["id"]), col["feature"] >= 0
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
    split = pa.StructArray.from_arrays([pa.array(col["feature"]), lists(col["threshold"][inner], inner.astype(int)), pa.array(np.full(n, -1, np.int32))],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [pa.array(col["id"]), pa.array(col["prediction"]), pa.array(col["impurity"]),
         lists(col["stats"].ravel(), np.full(n, col["stats"].shape[1])), pa.array(col["rawCount"]), pa.array(col["gain"]),
         pa.array(col["left"]), pa.array(col["right"]), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": pa.array(col["treeID"]), "nodeData": node})


def _model(spark: SparkSession, trees: int, width: int, nodes: pa.Table) -> RandomForestClassificationModel:
    """The model of a node table, read back from a saved model of as many single leaves with its nodes put in."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"trees-{uuid.uuid4().hex}")
    SC.pipeline(spark, SC.Forest(tuple(f"f{i}" for i in range(width)), (SC.Leaf(0.5, 1.0),) * trees)).stages[-1].write().save(path)
    data = os.path.join(path, "data")
    schema = spark.read.parquet(data).schema
    spark.createDataFrame(nodes).select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)).write.mode("overwrite").parquet(data)
    model = RandomForestClassificationModel.load(path)
    drop_tables(spark, [path])
    return model


def _rows(dataset: DataFrame, estimator) -> DataFrame:
    """(x, y, w): features, label and weight, refused where Spark ML refuses them."""
    x, y, w = vector_to_array(estimator.getFeaturesCol()), F.col(estimator.getLabelCol()).cast("double"), F.col(estimator.getWeightCol()).cast("double")
    unknown = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)
    checked = lambda v, bad, text: F.when(bad, F.raise_error(F.lit(text))).otherwise(v)
    return dataset.select(checked(x, x.isNull() | F.exists(x, unknown), "Vector values MUST NOT be NaN or Infinity").alias("x"),
                          checked(y, y.isNull() | ~y.isin(0.0, 1.0), "Labels MUST be 0 or 1").alias("y"),
                          checked(w, unknown(w) | (w < 0), "Weights MUST NOT be Negative or Infinity").alias("w"))


# ---------------------------------------------------------------- forest
class HistogramForestClassifier(RandomForestClassifier):
    """A random forest of two classes (gini), fitted by one job a level of all trees."""

    def _fit(self, dataset: DataFrame):
        spark, rows = dataset.sparkSession, _rows(dataset, self)
        cuts = _cuts(rows, rows.count(), self.getMaxBins(), self.getSeed())
        width, trees, depth = len(cuts), self.getNumTrees(), self.getMaxDepth()
        plan = {"cuts": cuts, "take": features_a_node(self.getFeatureSubsetStrategy(), width), "seed": self.getSeed() & (2**63 - 1),
                "share": self.getSubsamplingRate(), "replace": self.getBootstrap(), "min_rows": self.getMinInstancesPerNode(),
                "min_gain": self.getMinInfoGain()}
        blocks = rows.mapInArrow(_to_blocks(cuts), "bins binary, y binary, w binary").persist()
        grown = Grown.empty(trees, depth)
        frontier = [np.array([1])] * trees
        for level in range(depth):
            if not any(map(len, frontier)):
                break
            state = spark.sparkContext.broadcast(plan | {"level": level, "frontier": frontier, "feature": np.maximum(grown.feature, 0), "cut": grown.cut})
            sums = blocks.mapInArrow(_count_level(state), "tree int, part int, sums binary")
            found = sums.groupBy("tree").applyInArrow(_split_level(state), "tree int, splits binary").collect()  # as large as the model
            frontier = [np.empty(0, int)] * trees
            for r in found:
                frontier[r["tree"]] = _grow(grown, r["tree"], np.frombuffer(r["splits"], _SPLIT), level + 1 == depth)
            state.unpersist()
        blocks.unpersist()
        return self._copyValues(_model(spark, trees, width, node_table(grown, cuts)))


_SPLIT = np.dtype([("node", "i4"), ("feature", "i2"), ("cut", "u1"), ("gain", "f8"), ("left", "f8", 3), ("right", "f8", 3)])


def _grow(grown: Grown, tree: int, splits: np.ndarray, last: bool) -> np.ndarray:
    """Put a level's splits into a tree; returns the children that may be split."""
    at = splits["node"]
    grown.sums[tree, at] = splits["left"] + splits["right"]
    splits = splits[splits["gain"] > 0]
    at = splits["node"].astype(int)
    for name in ("feature", "cut", "gain"):
        getattr(grown, name)[tree, at] = splits[name]
    grown.sums[tree, 2 * at], grown.sums[tree, 2 * at + 1] = splits["left"], splits["right"]
    children = np.sort(np.concatenate([2 * at, 2 * at + 1]))
    return children[:0] if last else children[gini(grown.sums[tree, children]) >= _EPS]


def _to_blocks(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, y, w = _read([b], cuts)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (bins, y, w)], ["bins", "y", "w"])
    return run


def _layout(plan: dict, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(features, their numbers of bins, first places of their bins, places in all) of a tree's open nodes."""
    size = np.array([len(c) + 1 for c in plan["cuts"]])
    features = _subsets(len(plan["frontier"][tree]), len(size), plan["take"], plan["seed"], tree, plan["level"], 1)
    bins = size[features]
    ends = np.cumsum(bins.ravel())
    return features, bins, ends.reshape(bins.shape) - bins, int(ends[-1])


def _count_level(state):
    """Sums of a task's rows by the open nodes of each tree, their features and bins: rows, then weight of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, part = state.value, TaskContext.get().partitionId()
        width = len(plan["cuts"])
        blocks = [[np.frombuffer(v.as_buffer(), kind) for v, kind in zip(r, (np.uint8, float, float), strict=True)]
                  for b in batches for r in zip(*b.columns, strict=True)]
        if not blocks:
            return
        bins, y, w = (np.concatenate(x) for x in zip(*blocks, strict=True))
        label = y > 0
        pairs = (2 * bins.reshape(len(y), width) + label[:, None]).astype(np.uint8).ravel()  # (bin, class)
        same = [len(np.unique(w[label == c])) <= 1 for c in (0, 1)]
        of_class = [w[label == c][:1].sum() for c in (0, 1)] if all(same) else None  # a weight a class: rows alone are counted
        for tree, open_nodes in enumerate(plan["frontier"]):
            if not len(open_nodes):
                continue
            own, hits = _bag(plan, tree, part, len(y))
            first, node = own * width, np.ones(len(own), np.intp)
            feature, cut = plan["feature"][tree].astype(np.intp), plan["cut"][tree]
            for _ in range(plan["level"]):  # below a leaf it goes on to numbers that no open node has
                right = bins.take(first + feature.take(node)) > cut.take(node)
                node += node
                node += right
            slots = np.full(len(feature), -1)
            slots[open_nodes] = np.arange(len(open_nodes))
            slot = slots.take(node)
            if (slot < 0).any():
                on = np.flatnonzero(slot >= 0)
                own, hits, first, slot = own[on], hits[on], first[on], slot[on]
            features, _, starts, places = _layout(plan, tree)
            weight = None if of_class else w[own] * hits
            rows, weights = np.zeros(2 * places), np.zeros(2 * places)
            for f, start in zip(features.T.copy(), 2 * starts.T, strict=True):
                at = start.take(slot)
                at += pairs.take(first + f.take(slot))
                rows += np.bincount(at, hits, 2 * places)
                if weight is not None:
                    weights += np.bincount(at, weight, 2 * places)
            rows = rows.reshape(places, 2)
            sums = np.column_stack([rows.sum(1), rows * of_class if of_class else weights.reshape(places, 2)])
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                                             ["tree", "part", "sums"])
    return run


def _bag(plan: dict, tree: int, part: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a task that a tree sees, how often): a Poisson number of times, or once or not at all."""
    u = np.random.default_rng((plan["seed"], tree, part)).random(n)
    if not plan["replace"]:
        own = np.flatnonzero(u < plan["share"])
        return own, np.ones(len(own))
    most = np.cumsum([math.exp(k * math.log(plan["share"]) - plan["share"] - math.lgamma(k + 1)) for k in range(40)])
    own = np.flatnonzero(u >= most[0])
    return own, 1.0 + np.searchsorted(most[1:-1], u[own], "right")


def _split_level(state):
    def run(table: pa.Table) -> pa.Table:
        plan, tree = state.value, table.column("tree")[0].as_py()
        features, bins, _, places = _layout(plan, tree)
        parts = sorted(zip(table.column("part").to_pylist(), table.column("sums"), strict=True), key=lambda p: p[0])  # one order of adding
        flat = np.zeros((places, 3))
        for _, s in parts:
            flat += np.frombuffer(s.as_buffer()).reshape(places, 3)
        most = int(bins.max())
        sums = np.zeros((*bins.shape, most, 3))
        sums[np.arange(most) < bins[:, :, None]] = flat
        place, cut, gain, left, right = best_splits(sums, bins, plan["min_rows"], plan["min_gain"])
        out = np.zeros(len(place), _SPLIT)
        out["node"], out["feature"], out["cut"], out["gain"] = plan["frontier"][tree], features[np.arange(len(place)), place], cut, gain
        out["left"], out["right"] = left, right
        return pa.table({"tree": pa.array([tree], pa.int32()), "splits": pa.array([out.tobytes()], pa.binary())})
    return run
