import itertools
import random

from edge import SF, docs, odd_rows, soup

from lapse.llm import licenses as L

MIT = L.TEMPLATES["MIT (text)"]


def scan(text):
    return [(x["license"], x["coverage"], text[x["start"] : x["end"]]) for x in L.Scanner(L.TEMPLATES, L.COVERAGE, L.GAP).scan(text)]


def test_notices_copies_and_changed_texts():
    apache = L.TEMPLATES["Apache-2.0"]
    assert scan(f"{soup(1, 50)}\n{apache}.\n{soup(2, 50)}") == [("Apache-2.0", 1.0, apache)]
    assert [x[0] for x in scan(f"{apache}. {soup(1, 30)} {apache}. {apache}.")] == ["Apache-2.0"] * 3
    assert [x[0] for x in scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [x[0] for x in scan("Licensed under CC BY 4.0.")] == ["CC-BY-4.0"]
    words = MIT.split()
    changed = " ".join(w for k, w in enumerate(words) if k % 15) + " and more"
    [(name, coverage, _)] = scan(f"{soup(3, 40)} {changed} {soup(4, 40)}")
    assert name == "MIT (text)" and 0.85 < coverage < 1
    assert scan(" ".join(words[:40])) == [] and scan(soup(5, 3000)) == [] and scan("") == []
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    assert scan(" ".join(shuffled)) == []


def test_increasing_is_longest():
    rnd = random.Random(3)
    for _ in range(200):
        b = rnd.sample(range(12), 7)
        got = L.increasing(list(enumerate(b)))
        longest = max(n for n in range(8) for x in itertools.combinations(b, n) if list(x) == sorted(x))
        assert len(got) == longest and [j for _, j in got] == sorted(j for _, j in got)


def test_patience_aligns_equal_words_in_order_and_repeats_without_anchors():
    rnd = random.Random(4)
    for _ in range(100):
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert L.patience(list("xaybz"), list("ab")) == [(1, 0), (3, 1)]


def test_table_odd_rows_and_empty_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["license"] for r in L.report(L.license_spans(df)).collect()}
    for r in df.collect():
        lines = ("Apache License, Version 2.0", "under the MIT License", "General Public License, version 3", "under CC BY-NC 4.0")
        assert (got[r["doc_id"]] is not None) == any(x in (r["text"] or "") for x in lines)
    assert L.report(L.license_spans(docs(spark, odd_rows(), clash=True))).where("n_licenses = 0 AND spans = ''").count() == len(odd_rows())
    assert L.report(L.license_spans(docs(spark, []))).count() == 0


def test_insertions_missing_words_and_neighbouring_copies():
    words = MIT.split()
    for n in (8, 12, 30, 60):
        parted = " ".join([*words[:45], soup(n, n), *words[45:]])
        assert [x[:2] for x in scan(f"{soup(6, 40)} {parted} {soup(7, 40)}")] == [("MIT (text)", 1.0)]
    tokens = [w for w, _, _ in L.tokens(MIT)]
    once = [w for w in dict.fromkeys(tokens) if tokens.count(w) == 1]
    left = " ".join(w for w in tokens if w not in once[::2][:13])
    [(name, coverage, _)] = scan(f"{soup(8, 30)} {left} {soup(9, 30)}")
    assert (name, coverage) == ("MIT (text)", round(1 - 13 / len(tokens), 6))
    # Copies side by side, also without their first words, are told apart.
    for first, second in ((MIT, MIT), (MIT, " ".join(words[4:])), (" ".join(words[3:]), " ".join(words[5:])), (" ".join(words[3:]), MIT)):
        got = scan(f"{first} {second}")
        assert [x[0] for x in got] == ["MIT (text)"] * 2 and got[0][2] in first and got[1][2] in second
    three = " ".join(" ".join(words[k:]) for k in (2, 4, 6))
    assert [x[0] for x in scan(three)] == ["MIT (text)"] * 3


def test_gaps_without_anchors_are_aligned():
    assert L.patience(list("abab"), list("xababy")) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert len(L.patience(list("1abcabc2"), list("3abxcabxc4"))) == 6


def length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j], best[j + 1])
    return best[-1]


def test_gaps_without_anchors_are_aligned_whatever_their_size():
    rnd = random.Random(5)
    for n in (5, 60, 300):
        for words in ("ab", "abcdefgh"):
            a, b = ([rnd.choice(words) for _ in range(rnd.randint(n // 2, n))] for _ in range(2))
            pairs = L.common(a, b, 0, len(a), 0, len(b))
            assert len(pairs) == length(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    two = ["x", "y"] * 100
    assert len(L.patience(two, two[1:])) == 199


def test_every_template_is_found_whole_and_edited():
    scanner = L.Scanner(L.TEMPLATES, L.COVERAGE, L.GAP)
    for name, text in L.TEMPLATES.items():
        [found] = scanner.scan(f"{soup(1, 40)}\n{text}\n{soup(2, 40)}")
        assert (found["license"], found["coverage"]) == (name, 1.0)
        words = text.split()
        if len(words) >= 40:  # every 25th word goes, another comes now and then
            edited = " ".join(w if k % 25 else "zork" * (k % 2) for k, w in enumerate(words, 1))
            [found] = scanner.scan(f"{soup(3, 40)}\n{edited}\n{soup(4, 40)}")
            assert found["license"] == name and 0.8 <= found["coverage"] < 1


def test_a_template_without_its_distinguishing_words_does_not_win():
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for words, name in ((("library", "Lesser ", "2.1"), "LGPL-2.1 (notice)"), (("program", "Affero ", "3"), "AGPL-3.0 (notice)"),
                        (("program", "", "2"), "GPL-2.0 (notice)"), (("program", "", "3"), "GPL (notice)")):
        assert [x[0] for x in scan(gnu.format(*words))] == [name]
    assert [x[0] for x in scan(L._BSD + L._BSD_END)] == ["BSD-2-Clause (text)"]


def test_coverage_is_the_longest_common_subsequence_of_short_templates():
    """Against plain dynamic programming: patience alignment may find less than the longest, never more, and nearly all."""
    rnd, scanner = random.Random(6), L.Scanner({"MIT (text)": MIT}, 0.5, L.GAP)
    template = [w for w, _, _ in L.tokens(MIT)]
    for _ in range(30):
        words = [w for w in template if rnd.random() > 0.2]
        for _ in range(5):
            words.insert(rnd.randrange(len(words)), rnd.choice(["other", "the", "software"]))
        [found] = scanner.scan(" ".join(words))
        best = length(words, template) / len(template)
        assert best - 0.06 <= found["coverage"] <= best + 1e-6
