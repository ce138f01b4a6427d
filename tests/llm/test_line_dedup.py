from edge import SF, docs, odd_rows, soup

from lapse.llm import line_dedup as L


def brute(rows, least):
    """Lines of every document after deleting each window of enough words that has an earlier copy, all windows tried."""
    own = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0]))
    first, gone = {}, {x: set() for x in own}
    texts = [(x, x[1].split("\n")) for x in own]
    for d, (x, lines) in enumerate(texts):
        n = [len(s.encode().split()) for s in lines]
        for s in range(len(lines)):
            total = 0
            for e in range(s, len(lines)):
                total += n[e]
                if total >= least:
                    window = tuple(lines[s : e + 1])
                    if first.setdefault(window, (d, s)) != (d, s):
                        gone[x].update(range(s, e + 1))
    return {x: "\n".join(s for k, s in enumerate(lines) if k not in gone[x]) for x, lines in texts}


def check(spark, rows, least, clash=False):
    out = L.deduplicated(docs(spark, rows, clash), least)
    assert out.columns == docs(spark, rows, clash).columns
    want = brute([(r[0], r[1]) for r in rows], least)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted(
        ((r[0] or -1, want[(r[0], r[1] or "")]) for r in rows))


def passage(seed, lines, words=12):
    return [soup(seed * 100 + k, words) for k in range(lines)]


def test_runs_of_lines_against_all_windows(spark):
    p, q = passage(1, 6), passage(2, 9)
    rows = [
        (1, "\n".join(passage(11, 2) + p + passage(12, 2))),
        (2, "\n".join(passage(13, 1) + p + q)),
        (3, "\n".join(q[2:] + passage(14, 3) + p[1:5])),
        (4, "\n".join(p + ["", "short"] + p + ["", "short"] + q[:4])),  # a copy inside one document
        (5, "\n".join([q[0]] * 30)),  # overlaps itself
        (6, "\n".join(p[:2] + ["one more"] + p[2:4])),  # too few words in a row
        (7, "\n".join(p + q)),
        (7, "\n".join(p + q)),
        (8, "\n".join(p + q)),
    ]
    check(spark, rows, 30)


def test_long_runs_need_several_rounds(spark):
    """Copies of hundreds of lines, one of them broken in the middle."""
    p = [f"l{k % 37} {k % 11}" for k in range(400)]
    rows = [(1, "\n".join(p)), (2, "\n".join(["x y"] + p[:300])), (3, "\n".join(p[:150] + ["broken"] + p[151:]))]
    check(spark, rows, 40)


def test_odd_rows_and_empty_table(spark):
    check(spark, odd_rows(), 50, clash=True)
    assert L.report(docs(spark, [])).count() == 0


def test_suffix_ranks_are_the_sorted_suffixes(spark):
    lines = [["a", "b", "a", "b", "a"], ["b", "a", "b", "a"], ["a", "a"]]
    rows = [(k, "\n".join(s * 30 for s in x)) for k, x in enumerate(lines)]
    in_runs = L.runs(L.line_table(docs(spark, rows)), 1)
    table, levels = L.suffix_ranks(in_runs)
    found = [(r["doc_id"], p, x, f) for r in table.collect() for p, x, f in zip(r["pos"], r[f"r{levels - 1}"], r["r0"], strict=True)]
    letter = {(d, p): f for d, p, _, f in found}
    suffix = lambda d, p: [letter[(d, k)] for k in range(p, len(lines[d]))]
    order = sorted({tuple(suffix(d, p)) for d, p, _, _ in found})
    assert all(x == order.index(tuple(suffix(d, p))) + 1 for d, p, x, _ in found)


def test_report_over_the_test_table(spark):
    got = L.report(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.count() == 200 and got.where("n_deleted > n_lines").count() == 0
