import math
import random
from collections import Counter
from pathlib import Path

from edge import docs, odd_rows, soup

from lapse.llm import lmscore as M
from lapse.session import intermediate_scope


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute(rows, lab, n_words):
    words = Counter(w for _, t, *_ in rows for w in (t or "").lower().split())
    vocab = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))][:n_words]
    number = {w: k + 2 for k, w in enumerate(vocab)}
    size = len(vocab) + 2
    good = {i for i in {x[0] for x in lab} if min(q for j, q, _ in lab if j == i) == 1 and max(t for j, _, t in lab if j == i) == 0}
    seqs = [(i, [0] + [number.get(w, 1) for w in (t or "").lower().split()]) for i, t, *_ in rows]
    counts = {True: Counter(), False: Counter()}
    for i, s in seqs:
        counts[i in good].update(zip(s, s[1:], strict=False))
    total = {k: sum(c.values()) for k, c in counts.items()}
    scale = total[True] / total[False] if total[True] and total[False] else 1

    def loss(of, s):
        c = {k: v * (1 if of else scale) for k, v in counts[of].items()}
        uni, ctx = Counter(), Counter()
        for (a, b), v in c.items():
            uni[b] += v
            ctx[a] += v
        n = sum(uni.values()) + size
        return sum(-math.log((c.get((a, b), 0) + M.PRIOR * (uni[b] + 1) / n) / (ctx[a] + M.PRIOR)) for a, b in zip(s, s[1:], strict=False)) / max(1, len(s) - 1)

    return sorted((i or -1, len(s) - 1, round(loss(True, s), 4), round(loss(False, s), 4)) for i, s in seqs)


def test_scores_equal_brute_force(spark):
    rows = [(k, soup(k % 7, 30) + " The the THE") for k in range(20)] + [r for r in odd_rows() if r[0] != 4]
    rows = [(r[0], r[1]) for r in rows]
    lab = [(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 0, 0), (5, 1, 0), (5, 0, 0), (8, 1, 0), (999, 1, 0)]
    got = M.scores(docs(spark, rows, clash=True), labels(spark, lab), 25).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4)) for r in got) == brute(rows, lab, 25)
    assert all(abs(r["score"] - (r["background_loss"] - r["target_loss"])) < 1e-12 for r in got)


def test_good_documents_score_higher_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mean = {r["quality"]: r["s"] for r in M.scores(df, lab).join(lab, "doc_id").groupBy("quality").agg(M.F.avg("score").alias("s")).collect()}
    assert mean[1] > mean[0]
    assert M.scores(docs(spark, []), labels(spark, [])).count() == 0
    got = M.scores(docs(spark, odd_rows(), clash=True), labels(spark, [])).collect()
    assert len(got) == len(odd_rows()) and all(r["score"] == 0 for r in got if not r["n_tokens"])


def test_every_word_is_told_apart(spark):
    rows = [(k + 1, soup(k, 90) + " same words here " + soup(k % 5, 60)) for k in range(30)]
    rows += [(100 + k, " ".join(f"rare{j}" for j in range(40 * k, 40 * k + 60))) for k in range(40)]
    lab = [(k, 1, 0) for k in range(1, 31, 2)] + [(100 + k, 1, 0) for k in range(0, 40, 3)]
    assert len({w for _, t in rows for w in t.split()}) > 1_500
    got = M.scores(docs(spark, rows), labels(spark, lab)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4)) for r in got) == brute(rows, lab, 10**9)


def test_scores_do_not_depend_on_chunks_and_buckets(spark, monkeypatch):
    rows = [(k, soup(k % 9, 40) + " The the THE") for k in range(40)] + [(r[0], r[1]) for r in odd_rows() if r[0] != 4]
    lab = [(k, 1, 0) for k in range(0, 40, 3)]
    whole = sorted(map(str, M.scores(docs(spark, rows), labels(spark, lab)).collect()))
    monkeypatch.setattr(M, "CHUNK", 50)
    monkeypatch.setattr(M, "BUCKET", 20)
    got = M.scores(docs(spark, rows).repartition(3), labels(spark, lab)).collect()
    assert sorted(map(str, got)) == whole
    assert sorted((r["doc_id"] or -1, r["n_tokens"], round(r["target_loss"], 4), round(r["background_loss"], 4)) for r in got) == brute(rows, lab, 10**9)


def test_written_tables_are_a_few_bytes_a_token(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.3))}" for _ in range(1_000))) for k in range(300)]
    with intermediate_scope() as paths:
        out = M.scores(docs(spark, rows), labels(spark, [(k, 1, 0) for k in range(0, 300, 2)]))
    assert out.agg(M.F.sum("n_tokens")).first()[0] == 300_000
    assert sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet")) < 5 * 300_000
