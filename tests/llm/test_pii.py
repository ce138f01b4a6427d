import hashlib
import re

import numpy as np
from edge import SF, docs, odd_rows, soup

from lapse.llm import pii as P

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    t, out = text or "", []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "🙂 a.b+c@x-y.example.com, @no.com x@y a@b@c.de f@g..h .@-.-", "é 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 01.002.255.0 0001.2.3.4 1.2.3",
    "4111 1111-1111 1111 4111111111111112 5500-0000-0000-0004 4111 1111 1111 1111 1234", "+1 (212) 555-0100 +12 +1234567890123456 ++49 30 1234567.8 +1 2",
    "mail a@b.com.", "4" * 300 + " " + "4111111111111111", "1." * 50, "Dr. Anna Weber called (030) 123-4567 from DE89 3704 0044 0532 0130 00",
    "x" * 5000 + "@" + "y" * 5000 + "@a.b", "a@b.c@d.e",
]


def test_base_spans_equal_the_patterns():
    for t in TEXTS + [t for _, t, *_ in odd_rows()]:
        assert P.base_spans(t or "") == brute(t)


def test_long_runs_take_linear_time():
    import time
    began = time.time()
    for t in ("a" * 200_000 + " @", "@" * 100_000, "1" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 50_000, "1 " * 100_000):
        P.candidates(t)
    assert time.time() - began < 30


def test_query_rows(spark):
    rows = [(100 + k, t) for k, t in enumerate(TEXTS)] + odd_rows()
    got = P.digests(P.pii_spans(docs(spark, rows, clash=True))).collect()
    seen = []
    for r in got:
        base = [x for x in r["spans"].split(",") if x.split(":")[0] in P.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.BASE] == [sum(x.startswith(k + ":") for x in base) for k in P.BASE]
        seen.append((r["doc_id"] or -1, ",".join(base)))
    assert sorted(seen) == sorted((i or -1, ",".join(f"{P.BASE[k]}:{s}:{e}" for s, k, e in brute(t))) for i, t, *_ in rows)
    assert P.digests(P.pii_spans(docs(spark, []))).count() == 0


def test_whole_table_equals_the_patterns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in P.digests(P.pii_spans(df)).collect()}
    for r in df.collect():
        assert got[r["doc_id"]] == hashlib.sha256(",".join(f"{P.BASE[k]}:{s}:{e}" for s, k, e in brute(r["text"])).encode()).hexdigest()


def test_expectation_maximisation_finds_reliabilities_and_trains():
    """Votes drawn from known reliabilities: posteriors do as well as Bayes' rule with those, and the classifier follows."""
    rng = np.random.default_rng(5)
    n, good = 20_000, [0.9, 0.8, 0.75, 0.7, 0.55, 0.5]
    truth = rng.random(n) < 0.4
    votes = np.stack([np.where(rng.random(n) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in good], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    kinds, sizes = rng.integers(0, 2, n), rng.integers(0, 4, n)
    post = P.estimate(votes, kinds, np.ones(n))
    share = ((post > 0.5) == truth).mean()
    best = max((np.sign(votes[:, j]) == np.where(truth, 1, -1)).mean() for j in range(len(good)))
    odds = np.log(0.4 / 0.6) + votes @ np.log(np.array(good) / (1 - np.array(good)))
    ideal = ((odds > 0) == truth).mean()
    assert share > best and share > ideal - 0.01
    x = P.features(votes, kinds, sizes)
    w = P.train(x, post, np.ones(n))
    assert (((x @ w) > 0) == truth).mean() > ideal - 0.02
    for pattern in (0, 5, 728):
        assert sum((v + 1) * 3 ** (len(P.LABELERS) - 1 - k) for k, v in enumerate(P.unpack(pattern))) == pattern


def test_learned_kinds_are_added_and_noise_is_not(spark):
    good = "please call phone (030) 123-4567 now; konto iban DE89 3704 0044 0532 0130 00 bank; dear Dr. Anna Weber"
    rows = [(k, f"{soup(k, 20)} {good} a{k}@x.com, 10.0.0.{k % 200}") for k in range(60)] + [(100 + k, soup(k, 60)) for k in range(60)]
    got = {r["doc_id"]: r["spans"] for r in P.digests(P.pii_spans(docs(spark, rows))).collect()}
    assert "account" in got[1] and "local_phone" in got[1] and all(got[100 + k] == "" for k in range(60))


def test_cues_are_whole_words():
    at = lambda text, what: (text.index(what), P.KINDS.index("ip"), text.index(what) + len(what))
    cue = P.LABELERS.index("cue")
    for text, want in (("the ship 10.0.0.1 sails", 0), ("its IP: 10.0.0.1 here", 1), ("relationship 10.0.0.1", 0),
                       ("x" * 39 + "ip 10.0.0.1", 0), ("the server (10.0.0.1)", 1)):
        assert P.votes(text, at(text, "10.0.0.1"))[cue] == want
    counter = P.LABELERS.index("counter_cue")
    assert P.votes("version 10.0.0.1", at("version 10.0.0.1", "10.0.0.1"))[counter] == -1
    assert P.votes("conversion 10.0.0.1", at("conversion 10.0.0.1", "10.0.0.1"))[counter] == 0


def test_documents_with_personal_data_are_told(spark):
    rows = [(i, f"{soup(i, 30)} please mail {soup(i, 1)}.{soup(i + 1, 1)}@example{i}.com or call +1 (212) 555-{1000 + i} now") for i in range(20)]
    rows += [(100 + i, soup(200 + i, 60)) for i in range(20)]
    got = {r["doc_id"]: r["personal"] for r in P.digests(P.pii_spans(docs(spark, rows))).collect()}
    assert all(got[i] for i in range(20)) and not any(got[100 + i] for i in range(20))
