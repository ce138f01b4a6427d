import random

import numpy as np
import pytest
from edge import docs, odd_rows, soup

from lapse.llm import near_dedup as N
from lapse.llm.graph import components


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i or -1, len(s), least.get(find(k), -1) if s else (i or -1)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(spark, rows, size=4, **more):
    got = N.component_ids(docs(spark, rows, clash=True), size=size, **more).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == brute([(r[0], r[1]) for r in rows], size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def changed(text, seed, n):
    rnd, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
    return " ".join(w)


def test_odd_rows(spark):
    check(spark, [(i, t) for i, t, *_ in odd_rows()] + [(20, "one two"), (21, "ONE two"), (22, "one two three"), (23, "Ä b c d"), (24, "ä b c d")])


def test_empty_table(spark):
    assert N.component_ids(docs(spark, [])).count() == 0


def test_groups_passages_and_chains(spark, monkeypatch):
    """Exact copies, near copies around a base of which many are linked to each other alone, a passage in unlike texts,
    and chains; lists are made short so that both ways for open lists run."""
    monkeypatch.setattr(N, "SHORT", 4)
    monkeypatch.setattr(N, "BLOCK", 16)
    base, part = soup(1, 150), soup(2, 60)
    rows = [(1 + k, base) for k in range(5)]
    rows += [(100 + k, changed(base, k, random.Random(k).randint(1, 12))) for k in range(60)]
    rows += [(300 + k, changed(changed(base, k, 9), 1000 + k, 2)) for k in range(20)]
    rows += [(400 + k, f"{soup(400 + k, 25)} {part} {soup(500 + k, 20)}") for k in range(40)]
    chain = soup(7, 120)
    for k in range(12):
        rows.append((600 + k, chain))
        chain = changed(chain, k, 3)
    check(spark, rows)


def test_large_sketch_and_set_paths_agree(spark):
    base = soup(1, 400)
    rows = [(1 + k, changed(base, k, k % 16)) for k in range(30)] + [(50 + k, soup(60 + k, 300)) for k in range(10)]
    check(spark, rows, size=5, k=32)


def test_one_of_each(spark):
    rows = [(1, soup(1, 60)), (2, soup(1, 60)), (3, soup(3, 60)), (3, soup(3, 60)), (4, soup(4, 60)), (None, soup(1, 60)), (5, None), (6, "")]
    df = docs(spark, rows, clash=True)
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 1, 3, 4, 5, 6]


def test_least_shared_bounds_the_binomial_tail():
    rng = np.random.default_rng(1)
    for k in (16, 32, 64):
        t = N.least_shared(k, 80)
        assert 1 <= t <= 0.8 * k and (rng.binomial(k, 0.8, 100_000) >= t).all()


def test_blocks_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    got = N.compare_block(sets[:12], sets[12:], 80)
    for i, a in enumerate(sets[:12]):
        for j, b in enumerate(sets[12:]):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 80 * (len(a) + len(b) - both))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(20)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in range(130):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
