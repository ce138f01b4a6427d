import random
import re
from collections import Counter, defaultdict

from edge import SF, docs, odd_rows

from lapse.llm import divergence as V


def brute(rows, least=10, listed=10):
    """The contract by plain Python over (doc_id, text, lang, source)."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    terms = [(la or "", so or "", [fold(x) for x in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, la, so in rows]
    out = []
    for lang in {x[0] for x in terms}:
        df, count = Counter(), defaultdict(Counter)
        for la, so, ts in terms:
            if la == lang:
                df.update(set(ts))
                count[so].update(ts)
        kept = sorted(t for t, n in df.items() if n >= least)

        def freq(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        whole = freq(sum(count.values(), Counter()))
        ps = {so: freq(c) for so, c in count.items()}
        for so in ps:
            pairs = sorted((-sum(f(ps[so][t], ps[o][t]) for t in kept), o.encode()) for o in ps if o != so)
            ts = sorted((-f(ps[so][t], whole[t]), t.encode()) for t in kept if count[so][t] and ps[so][t] > whole[t])[:listed]
            out += [(lang, so, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", ts)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def sample():
    rnd = random.Random(7)
    words = ["alpha", "Beta", "GAMMA", "été", "Éclair", "ßx", "naïve", "中文", "d", "E", "f", "İstanbul"]
    return [(i, " 1,".join(rnd.choice(words[rnd.randint(0, 5):]) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "fr", None]),
             rnd.choice(["a", "b", "c", "é", None])) for i in range(90)] + [(900, "alone", "xx", "s1"), (901, None, "xx", "s2"), (902, "", "en", "empty")]


def test_audit_equals_brute_force(spark):
    rows = sample()
    got = rows_of(V.audit(docs(spark, rows, clash=True), least=3))
    assert got == brute(rows, 3) and {r[2] for r in got} == {"pair", "term"}


def test_shared_digests_are_split(spark):
    rows = sample()
    weak = lambda t: V.xxhash.xxh3_64_intdigest(t) % 3
    groups, seed = V.named_groups(docs(spark, rows))
    terms, _ = V.kept_terms(V._named(docs(spark, rows), seed), groups, 3, weak)
    assert terms.where("k > 1").count() > 0
    assert rows_of(V.audit(docs(spark, rows), least=3, digest=weak)) == brute(rows, 3)


def test_both_joins_agree_and_whole_table_equals_brute_force(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()])
    assert rows_of(V.audit(df)) == want
    monkeypatch.setattr(V, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(V, "COUNTED", 100)
    assert rows_of(V.audit(df)) == want


def test_odd_rows_and_empty_tables(spark):
    rows = odd_rows()
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1") for r in rows]
    assert rows_of(V.audit(docs(spark, rows, clash=True), least=2)) == brute(full, 2)
    assert V.audit(docs(spark, [])).count() == 0
    one = rows_of(V.audit(docs(spark, [(1, "a b c", "en", "x"), (2, None, None, None)])))
    assert one == []


def test_large_counts_stay_exact(spark):
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, 2 * big, 5)], "n long, total long, v long")
    assert row.select(V.frequency("n", "total", "v")).first()[0] == 1 + 10**9 * (big + 2) // (2 * big + 10)
