import random
from collections import Counter

import numpy as np
from edge import SF, docs, odd_rows

from lapse.llm import langid as L


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.predict(df, L.training_rows(df)).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 200 and right >= 0.98 * n
    assert out.where("score < 0 OR score > 1").count() == 0


def test_labels_of_held_out_rows_and_inputs_beside_the_text_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    a = L.predict(df, L.training_rows(df)).orderBy("doc_id").collect()
    b = L.predict(wrong, L.training_rows(wrong)).orderBy("doc_id").collect()
    assert a == b and {r["lang_pred"] for r in a} <= {"en", "de", "fr", "es", "und"}


def test_profiles_equal_counted_ngrams(spark):
    rows = [(1, "Abba ab", "aa"), (2, "ba 7 éa", "aa"), (3, "zz z", "bb")]
    got = {}
    for r in L.profiles(docs(spark, rows).select("text", "lang"), 12).orderBy("lang", "place").collect():
        got.setdefault(r["lang"], []).append(r["code"])
    for lang in ("aa", "bb"):
        counts = Counter()
        for _, t, own in rows:
            if own == lang:
                s = " " + " ".join(w for w in t.lower().split() if w.isalpha()) + " "
                for n in (1, 2, 3):
                    counts.update(sum(ord(c) << 21 * (n - 1 - j) for j, c in enumerate(s[k : k + n])) for k in range(len(s) - n + 1) if s[k : k + n] != " ")
        want = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:12]
        assert got[lang] == want


def test_out_of_place_distance(spark):
    p = L.Profiles([("aa", c, k) for k, c in enumerate(map(ord, "abc"))] + [("bb", c, k) for k, c in enumerate(map(ord, "cba"))], 3)
    own = L.ranked(np.array([ord("b"), ord("b"), ord("a")], dtype=np.uint64), 3)
    assert own.tolist() == [ord("b"), ord("a")]
    assert p.predict(None) == ("und", 0.0) and p.predict("12 ²") == ("und", 0.0)
    assert L.Profiles([]).predict("abc") == ("und", 0.0)


def test_odd_rows_empty_table_and_filter(spark):
    df = docs(spark, odd_rows(), clash=True)
    got = L.predict(df, L.training_rows(df)).collect()
    assert len(got) == len(odd_rows())
    unknown = {(r["doc_id"]) for r in got if r["lang_pred"] == "und"}
    assert unknown == {1, 2, 3, 7, 10}
    kept = L.identified(df, L.training_rows(df))
    assert kept.columns == df.columns and kept.count() == len(got) - 5
    empty = docs(spark, [])
    assert L.predict(empty, L.training_rows(empty)).count() == 0
    no_lang = docs(spark, [(1, "some text", None)])
    assert L.predict(no_lang, L.training_rows(no_lang)).first()["lang_pred"] == "und"


def test_noise_and_unlearned_languages_go_and_labelled_documents_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(7)
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(900)),
             "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2_000)),
             "asdf jkl qwer uiop zxcv " * 40, "Это предложение написано на русском языке. " * 20,
             "Ala ma kota a kot ma psa który mieszka w dużym domu nad rzeką gdzie płynie woda. " * 12]
    odd = docs(spark, [(10_000_000 + k, t, None) for k, t in enumerate(noise)])
    every = df.select(odd.columns).union(odd)
    kept = {r["doc_id"] for r in L.identified(every, L.training_rows(every)).select("doc_id").collect()}
    assert not kept & {10_000_000 + k for k in range(len(noise))}
    labelled = {r["doc_id"] for r in df.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id").collect()}
    assert len(labelled - kept) <= 0.005 * len(labelled)


def distance(text, profile, n):
    """Out-of-place distance by plain Python: the document's most frequent n-grams against a language's, `n` for a missing one."""
    import regex
    words = [w.lower() for w in regex.findall(r"[^\W\d_]+", text)]
    s = " " + " ".join(words) + " "
    counts = Counter(s[k : k + m] for m in (1, 2, 3) for k in range(len(s) - m + 1) if s[k : k + m] != " ")
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))
    own = sorted((number(g) for g in counts), key=lambda c: (-counts[spelled(c)], c))[:n]
    return sum(abs(k - profile[c]) if c in profile else n for k, c in enumerate(own)), len(own)


def spelled(code):
    out = ""
    while code:
        out, code = chr(code & 0x1FFFFF) + out, code >> 21
    return out


def test_predictions_and_scores_equal_plain_out_of_place_distances(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    training, n = L.training_rows(df), 60
    of = {}
    for r in L.profiles(training, n).collect():
        of.setdefault(r["lang"], {})[r["code"]] = r["place"]
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    seen = 0
    for r in L.predict(df, training, n).collect():
        if r["lang_pred"] == "und":
            continue
        away = {lang: distance(texts[r["doc_id"]], p, n) for lang, p in sorted(of.items())}
        best = min(away, key=lambda lang: away[lang][0])
        assert r["lang_pred"] == best and abs(r["score"] - (1 - away[best][0] / (n * away[best][1]))) < 1e-12
        seen += 1
    assert seen > 150
