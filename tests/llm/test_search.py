import math
import random
import re
from collections import Counter

import pyarrow as pa
from edge import SF, docs, odd_rows, soup

from lapse.llm import search as S


def brute(rows, items, best=20):
    """The contract by plain Python: (doc_id, text) rows, (item_id, text) items."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    own = [(i, Counter(terms(t))) for i, t in rows]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in own:
            m = 100 - 25 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:best], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def sample():
    rnd = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "été", "x1", "7", "naïve", "中文", "d", "E", "f", "İstanbul", *soup(8, 60).split()]
    return [(i, ", ".join(rnd.choice(words[: rnd.randint(2, len(words))]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]


ITEMS = [(1, "alpha ALPHA beta"), (2, "été-中文 7 unknown"), (3, None), (4, "..."), (5, "unknown words"), (6, soup(8, 20)), (6, soup(8, 20)), (7, "d d d d d")]


def test_ranks_equal_brute_force_for_every_sketch_width(spark):
    rows = sample()
    want = brute(rows, ITEMS, 5)
    for wide in (1, 7, 4096):
        assert rows_of(S.search(docs(spark, rows, clash=True), bench(spark, ITEMS), 5, wide)) == want
    assert {r[0] for r in want} == {1, 2, 6, 7}


def test_blocks_and_batches_change_nothing(spark, monkeypatch):
    rows = sample()
    want = brute(rows, ITEMS)
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "BATCH_TERMS", 6)
    assert len(list(S.query_batches(S.query_table(bench(spark, ITEMS))))) > 1
    assert rows_of(S.search(docs(spark, rows), bench(spark, ITEMS))) == want


def test_whole_table_equals_brute_force(spark):
    df, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in b.collect()])
    assert rows_of(S.search(df, b)) == want


def test_bounds_spare_most_exact_scores(spark):
    """Documents far from a query are never rescored, and none is lost."""
    rows = [(i, soup(i, 80)) for i in range(3000)] + [(5000 + i, soup(9, 40) + " " + soup(7000 + i, 40)) for i in range(30)]
    query = [(1, sorted(Counter(S.terms_of(soup(9, 40).encode())).items()))]
    held = Counter(t for _, x in rows for t in set(S.terms_of(x.encode())))
    total = sum(len(S.terms_of(x.encode())) for _, x in rows)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [x for _, x in rows]})
    seen = Counter()
    got = list(S.best_of_task(iter([batch]), query, {t: S.weight(len(rows), held[t]) for t, _ in query[0][1]}, len(rows), total, 20, 4096, seen))
    assert sorted((d, s) for _, d, s in got) == sorted((r[2], r[3]) for r in brute(rows, [(1, soup(9, 40))]))
    assert seen["documents"] < len(rows) / 2


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(5, "one two"), (3, "one two"), (3, "one two"), (None, "one two"), (9, "three"), (10, None), (11, "")]
    items = [(1, "one"), (None, "three one")]
    assert rows_of(S.search(docs(spark, rows), bench(spark, items))) == brute(rows, items)
    assert [r[2] for r in sorted(r for r in rows_of(S.search(docs(spark, rows), bench(spark, items))) if r[0] == 1)] == [3, 3, 5, None]


def test_odd_rows_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, soup(5, 80)), (2, "34"), (3, "")]
    assert rows_of(S.search(docs(spark, odd_rows(), clash=True), bench(spark, items))) == brute(rows, items)
    assert S.search(docs(spark, []), bench(spark, items)).count() == 0
    assert S.search(docs(spark, odd_rows()), bench(spark, [])).count() == 0
