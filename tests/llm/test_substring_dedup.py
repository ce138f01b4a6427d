import hashlib
import random
import re

import numpy as np
import pytest
from edge import SF, docs, odd_rows, soup

from lapse.llm import substring_dedup as D


def brute(rows, window=50):
    """The contract by plain Python over (doc_id, text) rows."""
    own = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in own:
        for p in range(len(ws) - window + 1) if i is not None else ():
            k = tuple(ws[p : p + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, ws in own:
        gone = set()
        for p in range(len(ws) - window + 1) if i is not None else ():
            if least[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(seed, n=60, words=3):
    """Texts over few words, so that short windows repeat everywhere; with runs, periods and copied passages."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        ws = [rnd.choice("abcdefgh"[:words]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            kind = rnd.random()
            if kind < 0.4 and out:
                src = out[rnd.randrange(len(out))][1].split()
                p = rnd.randint(0, len(src))
                part = src[p : p + rnd.randint(0, 40)]
            elif kind < 0.7:
                part = [rnd.choice("ab")] * rnd.randint(1, 20)
            else:
                part = (["a", "b", "c"][: rnd.randint(2, 3)]) * rnd.randint(1, 10)
            at = rnd.randint(0, len(ws))
            ws[at:at] = part
        out.append((rnd.randint(0, n), rnd.choice([" ", "\n", " \t"]).join(ws)))
    return out


@pytest.mark.parametrize(("window", "rounds", "words"), [(1, 1, 2), (4, 1, 2), (7, 2, 3), (10, 4, 3), (12, 4, 8), (20, 3, 2), (16, 0, 3)])
def test_equals_brute_force(spark, window, rounds, words):
    rows = sample(window, words=words)
    assert rows_of(D.report(docs(spark, rows, clash=True), window, rounds)) == brute(rows, window)


def test_segments_and_joins_change_nothing(spark, monkeypatch):
    rows = sample(99) + [(i, soup(5, 300)[k:]) for i, k in ((70, 0), (71, 9), (72, 400))]
    want = brute(rows, 10)
    for name, value in (("SEGMENT", 16), ("BROADCAST_ANCHORS", 0), ("BROADCAST_DOCS", 0)):
        monkeypatch.setattr(D, name, value)
        assert rows_of(D.report(docs(spark, rows), 10)) == want


def test_symbols_inside_a_window_do_not_depend_on_its_neighbours():
    rnd = random.Random(4)
    for _ in range(200):
        window = rnd.randint(5, 50)
        middle = [rnd.randint(1, rnd.choice([2, 5, 90])) for _ in range(window)]
        seen = []
        for _ in range(2):
            left, right = ([rnd.randint(1, 5) for _ in range(rnd.randint(0, 20))] for _ in range(2))
            h = D._mix(np.array([*left, *middle, *right], dtype=np.uint64))
            names, first, lo, hi = D.parse(h, np.zeros(len(h), dtype=np.int64), np.array([len(left)]), window)
            seen.append((names[lo[0] : hi[0]].tolist(), (first[lo[0] : hi[0]] - len(left)).tolist()) if lo[0] < hi[0] else None)
        assert seen[0] == seen[1]


def test_windows_of_prose_share_anchors():
    """A stretch stands for many windows, so that few rows are shuffled."""
    h = np.array([D.xxhash.xxh3_64_intdigest(w) for w in soup(1, 20_000).split()], dtype=np.uint64)
    start = np.arange(len(h) - 49)
    anchor, *_, n = D.stretches_of(h, np.zeros(len(h), dtype=np.int64), start)
    assert n.sum() == len(start) and len(n) < len(start) / 8


def test_passages_of_fifty_words_and_more(spark):
    a, b = soup(11, 50), soup(12, 49)
    rows = [(1, f"{soup(1, 30)} {a} {soup(2, 30)}"), (2, f"{soup(3, 10)} {a}\n{soup(4, 5)}"), (3, f"{b} {soup(5, 9)}"), (4, f"{soup(6, 9)} {b}"),
            (5, soup(7, 200)), (6, soup(7, 200)), (6, soup(7, 200)), (None, soup(7, 200)), (0, f"{a} {a}")]
    got = rows_of(D.report(docs(spark, rows)))
    assert got == brute(rows)
    assert [(r[0], r[2]) for r in got if r[2]] == [(1, 50), (2, 50), (6, 200), (6, 200)]


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(D.report(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_odd_rows_and_empty_tables(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert rows_of(D.report(docs(spark, odd_rows(), clash=True))) == brute(rows)
    assert D.report(docs(spark, [])).count() == 0
    runs = [(1, "x " * 400), (2, "x " * 49), (3, "y x " * 90), (4, "x " * 120)]
    assert rows_of(D.report(docs(spark, runs))) == brute(runs)
