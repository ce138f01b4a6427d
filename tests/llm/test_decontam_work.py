"""Work of decontamination a word: hashes of whole words and of pairs are computed once."""

from pyspark.sql import functions as F

from lapse.llm import decontam as M

WORDS = ["\x02The", "cat", "Σ", "ΟΔΟΣ", "\x02ΟΔΟΣ", "ΟΔΟΣ\x02α", "seven", "km", "12", "12.5", "\x0212", "Paris", "PARIS", "\x02Km", "İ", "x\x02Y", ""]


def test_hashes_of_odd_words_are_those_of_each_word_alone(spark):
    one = spark.createDataFrame([(k, [w]) for k, w in enumerate(WORDS)], "key long, ws array<string>")
    want = {r["key"]: (r["c"], r["v"]) for r in one.select("key", F.xxhash64(M.canonical(F.col("ws")[0])).alias("c"), F.xxhash64(
        F.lit(1), F.lower(F.translate(F.col("ws")[0], "\x02", ""))).alias("v")).collect()}
    row = M.hashed(spark.createDataFrame([(0, WORDS)], "key long, ws array<string>"), ["key"]).first()
    assert list(zip(row["cs"], row["vs"], strict=True)) == [want[k] for k in range(len(WORDS))]


def test_a_pair_of_words_is_mixed_once_and_only_table_pairs_begin(spark):
    words = M.hashed(spark.createDataFrame([(0, ["a", "b", "c", "d", "e"])], "key long, ws array<string>"), ["key"])
    begins = words.select(F.slice("cs", 2, 2).alias("begin"))
    found = M.windows(words, [1, 2, 3], ["key"], M.bit_table(begins))
    assert {(r["place"], r["length"]) for r in found.where("NOT as_is").collect()} >= {(2, 2), (2, 3)}
    pairs = M.windows(words, [3], ["key"], M.bit_table(begins))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("shiftleft(") == 2  # one a form
