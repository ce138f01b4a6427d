from collections import Counter

from edge import SF, docs, odd_rows, soup

from lapse.llm import quality as Q


def brute(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


ROWS = [(30, "a b c a b c a"), (31, "x y z w x y z"), (32, "## ** a|b <c> &%$"), (33, "same line\nsame line\n \n \nsame  line"),
        (34, "é è ü " * 40), (35, "THE " * 60), (36, soup(8, 200)), (37, "a " * 500), *odd_rows()]
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measurements_equal_brute_force(spark):
    got = Q.verdicts(docs(spark, ROWS, clash=True)).collect()
    assert sorted((r["doc_id"] or -1, *(r[f] for f in FIELDS)) for r in got) == sorted((i or -1, *brute(t)) for i, t, *_ in ROWS)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        assert bool(r["failed"] & Q.BASE) == r["base_failed"]


def test_policies_and_ablations_read_the_bits_alone(spark):
    led = Q.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    bits = [r["failed"] for r in led.collect()]
    for policy in Q.POLICIES:
        rejects = lambda b, p=policy: bool(b & p.fatal) or bin(b & p.counted).count("1") > p.tolerated
        kept = Q.apply_policies(led).where(f"kept_v{policy.version}").count()
        assert kept == sum(not rejects(b) for b in bits)
        for r in Q.ablations(led, policy).collect():
            bit = Q.BIT[r["rule"]]
            assert r["fails"] == sum(bool(b & bit) for b in bits)
            assert r["rejects_alone"] == sum(rejects(b) and not rejects(b & ~bit) for b in bits)
            assert r["kept_without"] == sum(not rejects(b & ~bit) for b in bits)


def test_the_query_has_every_policy_and_the_ablation_of_each_document(spark):
    rows = Q.verdicts(docs(spark, [*ROWS, (40, soup(9, 80).upper())])).collect()
    rejects = lambda p, b: bool(b & p.fatal) or bin(b & p.counted).count("1") > p.tolerated
    now = next(p for p in Q.POLICIES if p.version == Q.CURRENT)
    for r in rows:
        assert [r[f"kept_v{p.version}"] for p in Q.POLICIES] == [not rejects(p, r["failed"]) for p in Q.POLICIES]
        alone = sum(b for b in Q.BIT.values() if rejects(now, r["failed"]) and not rejects(now, r["failed"] & ~b))
        assert r["rejected_alone"] == alone
    assert any(r["rejected_alone"] for r in rows) and any(r["kept_v1"] != r["kept_v2"] for r in rows)


def test_clean_text_is_kept_and_empty_table_passes(spark):
    assert Q.verdicts(docs(spark, [(1, soup(1, 300))])).first()["kept"]
    assert Q.verdicts(docs(spark, [])).count() == 0
