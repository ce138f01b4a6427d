"""Inputs that every operator has to take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["row", "key", "key_", "th", "th_", "run", "pos", "n", "node", "label", "family", "found", "spans", "hash", "kind", "v",
            "words", "ws", "cs", "lines", "lines_", "deleted_", "doc_id_", "held_out", "target", "ids", "owner", "repo", "sketch", "w"]


def soup(seed, n, k=40):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) for _ in range(n)) if k else ""


def docs(spark, rows, clash=False):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if clash else df


def odd_rows():
    long = soup(3, 30_000)
    return [(1, None), (2, ""), (3, " \t\n \x0b"), (4, long), (5, soup(5, 80)), (5, soup(5, 80)), (None, soup(6, 90)),
            (7, "12 34 !?"), (8, soup(5, 80)), (9, soup(9, 60), None, None), (10, "\n\n\n")]
