"""Operator 4: quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps the measurements and
one failure bit a rule. Policies (versions with a mask of rules, and how many
further rules may fail) and ablations read the bits alone, by bitwise
expressions and one aggregation over distinct masks.

A text of any length is one row, its words and windows arrays of that row.
Null text: as empty. Empty text: fails the length rules. Repeated rows: each
has its own row. An empty table gives an empty ledger; columns of `docs` beyond
doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import texts, words

#: Rules in bit order: bit i is set where the condition holds, i.e. the document fails. The first two are the base.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("no_words", "n_words = 0"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("dup_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("capitals", "n_letters >= 50 AND 10 * n_capitals > 7 * n_letters"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """Rejects on any failure in `fatal`, or on more than `tolerated` failures in `counted`."""

    version: int
    fatal: int
    counted: int = 0
    tolerated: int = 0

    def rejects(self, bits: Column) -> Column:
        counted = F.bit_count(bits.bitwiseAND(F.lit(self.counted)))
        return (bits.bitwiseAND(F.lit(self.fatal)) != 0) | (counted > self.tolerated)


SOFT = BIT["symbols"] | BIT["dup_lines"] | BIT["few_letters"] | BIT["capitals"] | BIT["short_words"] | BIT["long_words"]
POLICIES = [
    Policy(1, BASE | BIT["no_words"]),
    Policy(2, BASE | BIT["no_words"] | SOFT),
    Policy(3, BASE | BIT["no_words"] | BIT["long_words"] | BIT["symbols"] | BIT["capitals"],
           BIT["dup_lines"] | BIT["few_letters"] | BIT["short_words"], 1),
]
CURRENT = 3


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of `ws` in 3-word windows that occur twice or more. Most texts end at the test on
    distinct hashes; else windows are sorted with their places, and each that equals a neighbour covers its three
    words. Steps are columns of their own, since a lambda would evaluate an inlined array anew for each element."""
    ws, n = F.col("ws"), F.col("n_windows")
    window = lambda i: F.array(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2))
    none = F.array().cast("array<struct<w:string,i:int>>")
    twice = lambda x, k: ((k > 0) & (F.get("sorted", k - 1)["w"] == x["w"])) | (F.get("sorted", k + 1)["w"] == x["w"])
    return (
        df.withColumn("n_windows", F.greatest(F.size("ws") - 2, F.lit(0)))
        .withColumn("at", F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")))
        .withColumn("all_differ", F.size(F.array_distinct(F.transform("at", lambda i: F.xxhash64(window(i))))) == n)
        .withColumn("sorted", F.when(F.col("all_differ"), none).otherwise(F.sort_array(F.transform(
            "at", lambda i: F.struct(F.array_join(window(i), " ").alias("w"), i.alias("i"))))))
        .withColumn("covering", F.filter("sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))))
        .withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform(
            "covering", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long")))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row a document, `failed` with a bit for each rule that it fails."""
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    split = _with_repeat_words(texts(docs).withColumn("ws", words(F.col("text")))).withColumn(
        "ls", F.filter(F.split("text", "\n"), has_word)).withColumn("joined", F.array_join("ws", ""))
    joined = F.col("joined")
    count = lambda of, cls: (F.size(F.split(of, cls, -1)) - 1).cast("long")
    measured = split.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        count(F.col("text"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("ls").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(joined, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(joined, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )
    bits = sum((F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def apply_policies(led: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """The ledger with a boolean kept_v<version> for each policy, from the bits alone."""
    return led.withColumns({f"kept_v{p.version}": ~p.rejects(F.col("failed")) for p in policies})


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """(rule, fails, rejects_alone, kept_without): by rule, documents that fail it, that the policy rejects but would
    keep without it, and kept in all without it. One count by distinct mask (2^rules at most), then bitwise sums."""
    masks = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    one = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES)))
    each = masks.withColumn("_", one).select("n", "failed", "_.rule", "_.bit")
    now, without = policy.rejects(F.col("failed")), policy.rejects(F.col("failed").bitwiseAND(F.bitwise_not("bit")))
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return each.groupBy("rule").agg(total(F.col("failed").bitwiseAND(F.col("bit")) != 0, "fails"),
                                    total(now & ~without, "rejects_alone"), total(~without, "kept_without"))


def rejected_alone(policy: Policy, bits: Column) -> Column:
    """Bits of the rules without which the policy would keep a document that it rejects: the ablation of one document."""
    without = (F.when(policy.rejects(bits.bitwiseAND(F.lit(~b))), 0).otherwise(b) for b in BIT.values())
    return F.when(policy.rejects(bits), sum(without, F.lit(0))).otherwise(0).cast("long")


def verdicts(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed, the verdict of a policy version and those of all, and the rules that alone reject."""
    policy = next(p for p in POLICIES if p.version == version)
    return apply_policies(ledger(docs)).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0).withColumn(
        "kept", ~F.col("base_failed") & ~policy.rejects(F.col("failed"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed",
        "n_lines", "n_letters", "n_capitals", *(f"kept_v{p.version}" for p in POLICIES),
        rejected_alone(policy, F.col("failed")).alias("rejected_alone"))


def _rejects_sql(p: Policy, bits: str) -> str:
    return f"(({bits} & {p.fatal}) <> 0 OR bit_count({bits} & {p.counted}) > {p.tolerated})"


_NOW = next(p for p in POLICIES if p.version == CURRENT)
_ALONE = " + ".join(f"CASE WHEN {_rejects_sql(_NOW, f'(failed & {(1 << len(RULES)) - 1 - b})')} THEN 0 ELSE {b} END" for b in BIT.values())
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(length(regexp_replace(array_to_string(ws, ''), '\P{L}+', '', 'g')) AS BIGINT) AS n_letters,
      CAST(length(regexp_replace(array_to_string(ws, ''), '\P{Lu}+', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words = 0)::INT
      + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 25 * n_words)::INT + 32 * (2 * n_symbols > n_words)::INT
      + 64 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 128 * (2 * n_letters < word_chars)::INT
      + 256 * (n_letters >= 50 AND 10 * n_capitals > 7 * n_letters)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
  (failed & 311) = 0 AND bit_count(failed & 200) <= 1 AS kept, failed, n_lines, n_letters, n_capitals,
  """ + ", ".join(f"NOT {_rejects_sql(p, 'failed')} AS kept_v{p.version}" for p in POLICIES) + f""",
  CAST(CASE WHEN {_rejects_sql(_NOW, 'failed')} THEN {_ALONE} ELSE 0 END AS BIGINT) AS rejected_alone FROM f
"""
