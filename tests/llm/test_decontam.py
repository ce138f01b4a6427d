import re

from edge import SF, docs, odd_rows, soup

from lapse.llm import decontam as D

ITEM = "If Anna buys 3 apples for 4 dollars and Peter sells 3 apples for 9 dollars how much does Anna win in the whole week"
OTHER = "If Maria buys 17 apples for 2 dollars and Carlos sells 17 apples for 8 dollars how much does Maria win in the whole week"
UNLIKE = "If Maria buys 17 apples for 2 dollars and Carlos sells 5 apples for 8 dollars how much does Nina win in the whole week"


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def canonical(text):
    """The same canonical words by plain Python."""
    import regex
    marked = regex.sub(r"""(\A|[.!?:;\n][ \t\n\x0b\f\r"'(\[]{0,4})(?=\p{Lu})""", lambda m: m[1] + "\x02", text)
    raw = [w for w in regex.split(r"(?:[^\p{L}\p{N}.,\x02]|[.,](?![0-9])|(?<![0-9])[.,])+", marked) if w]
    out = []
    for w in raw:
        if w == w.lower():
            out.append("\x02n" if re.match("[0-9]", w) or w in D.NUMBERS else "\x02u" if w in D.UNITS else w)
        elif w.startswith("\x02"):
            out.append(w[1:].lower())
        else:
            out.append("\x02p" if regex.match(r"\p{Lu}\p{Ll}", w) else w.lower())
    return out


def test_canonical_words_equal_plain_python(spark):
    texts = [ITEM, "He paid 3.5 euros, or 1,000. Then Tom, 12km and THE USA. “Éva” ran.\nNew: Line (Bob) two", soup(1, 50)]
    df = docs(spark, list(enumerate(texts))).select("doc_id", D.raw_words(D.F.col("text")).alias("ws")).select(
        "doc_id", D.F.transform("ws", D.canonical).alias("cs"))
    got = {r["doc_id"]: r["cs"] for r in df.collect()}
    assert [got[k] for k in range(3)] == [canonical(t) for t in texts]


def test_reparameterised_questions_and_slots(spark):
    rows = [(1, f"{soup(1, 30)}. {OTHER}. {soup(2, 30)}"), (2, f"{soup(3, 30)}. {UNLIKE}."), (3, f"x. {ITEM}"), (4, soup(4, 200)),
            (5, f"{soup(5, 10)}. {OTHER}. {soup(6, 10)}. {ITEM}. {soup(7, 5)}"), (6, ITEM.split(" for ")[0])]
    got = {r["doc_id"]: r for r in D.contaminated(docs(spark, rows, clash=True), bench(spark, [(7, ITEM), (8, None), (9, "")])).collect()}
    assert [got[k]["contaminated"] for k in range(1, 7)] == [True, False, True, False, True, False]
    assert got[1]["item_ids"] == [7] and got[1]["coverage"] == 0.6  # windows of few literal words cover nothing
    left = D.clean(docs(spark, rows, clash=True), bench(spark, [(7, ITEM)]))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 6] and left.columns == docs(spark, rows, clash=True).columns


def test_both_joins_agree(spark, monkeypatch):
    df, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: sorted(map(str, D.contaminated(df, b).collect()))
    few = rows()
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert rows() == few


def test_whole_items_in_documents_are_found_and_others_are_not(spark):
    sf = "/root/testdata/sf0.01"
    df, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join((t or "").split())
    items = {r["item_id"]: flat(r["text"]) for r in b.collect()}
    texts = {r["doc_id"]: flat(r["text"]) for r in df.collect()}
    for r in D.contaminated(df, b).collect():
        assert r["item_ids"] == sorted(i for i, t in items.items() if t in texts[r["doc_id"]])


def test_window_matches_equal_brute_force(spark):
    rows = [(1, f"{soup(1, 30)} {ITEM} {soup(2, 9)}"), (2, f"{OTHER} {OTHER}"), (3, "")]
    items = D.item_windows(bench(spark, [(7, ITEM), (8, "a short one here")])).cache()
    got = D.matches(docs(spark, rows), items, [4, 8], True)
    want = 0
    for _, t in rows:
        cs = canonical(t)
        for item in (canonical(ITEM), canonical("a short one here")):
            n = min(8, len(item))
            for p in range(len(item) - n + 1):
                w = item[p : p + n]
                if sum(not x.startswith("\x02") for x in w) >= D.LITERAL * n:
                    want += sum(cs[q : q + n] == w for q in range(len(cs) - n + 1))
    assert got.count() == want > 0


def test_odd_rows_and_empty_tables(spark):
    got = D.contaminated(docs(spark, odd_rows(), clash=True), bench(spark, [(1, soup(5, 80)), (None, soup(9, 60))]))
    assert got.count() == len(odd_rows())
    assert sorted(r["doc_id"] for r in got.where("contaminated").collect() if r["doc_id"]) == [5, 5, 8]
    assert D.contaminated(docs(spark, odd_rows()), bench(spark, [])).where("contaminated").count() == 0
    assert D.contaminated(docs(spark, []), bench(spark, [(1, ITEM)])).count() == 0


def test_a_disagreeing_slot_takes_out_its_windows_alone(spark):
    item = f"{soup(21, 3)} Anna {soup(22, 25)} Anna {soup(23, 29)}"
    changed = item[::-1].replace("annA", "aniN", 1)[::-1]
    assert changed.count("Anna") == changed.count("Nina") == 1
    rows = [(1, f"{soup(31, 30)} {changed} {soup(32, 30)}"), (2, f"{soup(33, 20)} {item}"), (3, UNLIKE)]
    got = {r["doc_id"]: r for r in D.contaminated(docs(spark, rows), bench(spark, [(7, item), (8, ITEM)])).collect()}
    assert [got[k]["item_ids"] for k in (1, 2, 3)] == [[7], [7], []]
    # 59 words have 52 windows; 8 hold the changed name.
    assert (got[1]["n_windows"], got[2]["n_windows"]) == (44, 52) and got[1]["coverage"] == 58 / 59


def test_items_of_few_literal_words_are_found_as_they_stand(spark):
    cities = "Paris London Berlin Madrid Rome Vienna Lisbon Dublin Prague Warsaw Athens Oslo"
    sums = "12 + 30 = 42, 17 + 4 = 21, 8 + 9 = 17, 30 + 3 = 33"
    short = "Whales sing in the deep blue sea"
    items = [(1, cities), (2, sums), (3, short), (4, "7 8 Anna"), (5, None), (6, " ")]
    rows = [(1, f"{soup(1, 20)} {cities} {soup(2, 9)}"), (2, f"x {sums}"), (3, f"{soup(3, 20)} - {short}, {soup(4, 20)}"),
            (4, "they said 7 8 ANNA then"), (5, cities.replace("Rome", "Turin").replace("Oslo", "Bern")[::-1]), (6, "13 + 31 = 44, 18 + 5 = 23, 9 + 10 = 19"), (7, "7 8 Nina")]
    got = {r["doc_id"]: r for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert [got[k]["item_ids"] for k in range(1, 8)] == [[1], [2], [3], [4], [], [], []]
    assert [got[k]["n_windows"] for k in range(1, 5)] == [5, 5, 1, 1]
    assert [r["doc_id"] for r in D.clean(docs(spark, rows), bench(spark, items)).orderBy("doc_id").collect()] == [5, 6, 7]


def test_a_window_found_both_ways_counts_once(spark):
    text = soup(41, 20)
    got = D.contaminated(docs(spark, [(1, text), (1, text)]), bench(spark, [(1, text)])).collect()
    assert [(r["n_windows"], r["coverage"]) for r in got] == [(13, 1.0)] * 2


def test_numbers_and_units_of_four_languages(spark):
    items = [(1, "wenn ein bauer zwei kühe und sieben schafe auf der weide hält und jede woche neun liter milch verkauft wie lange reicht es"),
             (2, "si une femme achète trois pommes et quatre poires chaque semaine pendant huit jours combien de fruits mange toute la famille"),
             (3, "si un hombre compra cinco libros y ocho plumas cada mes durante nueve años cuántas cosas tiene al final de todo esto")]
    other = [items[0][1].replace("zwei", "drei").replace("sieben", "acht").replace("neun liter", "zehn gramm"),
             items[1][1].replace("trois", "5").replace("quatre", "douze").replace("huit jours", "sept heures"),
             items[2][1].replace("cinco", "12").replace("ocho", "diez").replace("nueve años", "seis semanas")]
    rows = [(10 + i, f"{soup(60 + i, 20)} {t} {soup(70 + i, 20)}") for i, t in enumerate(other)]
    got = {r["doc_id"]: r["item_ids"] for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {10: [1], 11: [2], 12: [3]}
