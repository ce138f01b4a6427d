"""TreeSHAP against brute-force Shapley values of the cover-weighted conditional expectation."""

import itertools
import math

import numpy as np

from lapse.operators.explain import Tree, leaves, shap_matrix


def _random_tree(rng, depth, n_feat):
    left, right, feat, thr, val, cov = [], [], [], [], [], []

    def node(d, count):
        i = len(left)
        left.append(-1); right.append(-1); feat.append(0); thr.append(0.0); val.append(float(rng.normal())); cov.append(count)
        if d < depth:
            feat[i] = int(rng.integers(n_feat)); thr[i] = float(rng.normal())
            share = int(rng.integers(1, count)) if count > 1 else 1
            left[i] = node(d + 1, share)
            right[i] = node(d + 1, max(count - share, 1))
        return i

    node(0, 1000)
    return Tree(left, right, feat, thr, val, cov)


def _cond_exp(tree, x, s, j=0):
    if tree.left[j] < 0:
        return tree.value[j]
    d = tree.feature[j]
    if d in s:
        nxt = tree.left[j] if x[d] <= tree.threshold[j] else tree.right[j]
        return _cond_exp(tree, x, s, nxt)
    l, r = tree.left[j], tree.right[j]
    return (tree.cover[l] * _cond_exp(tree, x, s, l) + tree.cover[r] * _cond_exp(tree, x, s, r)) / tree.cover[j]


def _brute(tree, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for size in range(m):
            for s in itertools.combinations(others, size):
                wgt = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += wgt * (_cond_exp(tree, x, set(s) | {i}) - _cond_exp(tree, x, set(s)))
    return phi


def test_tree_shap_matches_brute_force_and_local_accuracy():
    rng = np.random.default_rng(7)
    for _ in range(25):
        m = 4
        tree = _random_tree(rng, depth=int(rng.integers(1, 5)), n_feat=m)
        x = rng.normal(size=m)
        phi = shap_matrix([(1.0, leaves(tree))], x[None, :])[0]
        assert np.allclose(phi, _brute(tree, x, m), atol=1e-9)
        assert abs(phi.sum() + tree.expected_value() - tree.predict(x)) < 1e-9


def test_shap_matrix_adds_weighted_trees_for_all_rows():
    rng = np.random.default_rng(11)
    trees = [_random_tree(rng, 3, 5) for _ in range(4)]
    weights = [1.0, 0.5, 2.0, 0.1]
    xs = rng.normal(size=(17, 5))
    got = shap_matrix([(w, leaves(t)) for t, w in zip(trees, weights)], xs)
    for x, phi in zip(xs, got):
        assert np.allclose(phi, sum(w * _brute(t, x, 5) for t, w in zip(trees, weights)), atol=1e-9)
