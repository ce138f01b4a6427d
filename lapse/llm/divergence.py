"""Operator 12: source divergence audit with late string materialisation.

Each language keeps the terms that at least `least` of its documents hold. Every
source of a language is compared with the language (the terms that it uses most
beyond it) and with every other source, by a symmetric chi-square-like distance
of smoothed frequencies, all in whole numbers.

What is shuffled are 64-bit digests of terms, not terms, beside 64-bit numbers of
languages and groups: first (language, digest) with document counts, then (group,
digest) with occurrences of kept digests alone. Of kept digests the distinct strings are gathered once,
and their minimum and maximum tell where two terms share a digest; those few are
counted again by their strings and get numbers of their own. Strings are joined
back for the terms that a report lists.

Distances over all kept terms don't visit terms that neither source holds. With
p0 the frequency of a term that a source doesn't hold, the sum over all V terms
is: (V - a - b) * f(p0, q0), a and b being the terms of either source; each
source's own terms against the other's p0, by a histogram of its counts; and, for
terms that both hold, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

Null text, lang or source: as empty. A group without terms has all pairs and no
terms. Repeated rows count each. Ties: by the item's UTF-8 bytes. An empty table
gives an empty result; a text of any length is one list of terms in its task.
Extra columns are ignored. Sums of occurrences are exact up to 2^63, distances
for as many terms as 9 * 10^9.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.session import materialize

#: Least documents of a language that hold a kept term, and terms listed for a source.
LEAST, LISTED = 10, 10
#: Most kept terms whose digests are broadcast; beyond it, counts are joined with them by a shuffle.
BROADCAST_TERMS = 500_000
#: Entries of a task's tables of counts.
COUNTED = 300_000

Digest = Callable[[bytes], int]
_TERM = ["l", "d"]
#: What separates terms, to spaces, and A-Z to a-z; bytes from 0x80 on, i.e. all of a character that isn't ASCII, stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _named(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, source, l, g, text): l and g are hashes of the language, and of language and source."""
    own = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return own.select("lang", "source", F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g"), "text")


def named_groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, l, g) of every occurring group, and the seed under which no two languages or groups share a number."""
    for seed in count():
        groups = materialize(_named(docs, seed).drop("text").distinct(), "op12-groups")
        sizes = groups.agg(F.count(F.lit(1)), F.count_distinct("g"), F.count_distinct("lang"), F.count_distinct("l")).first()
        if sizes[0] == sizes[1] and sizes[2] == sizes[3]:
            return groups, seed
    raise AssertionError


def counted(named: DataFrame, by: str, digest: Digest, *, once: bool = False, strings: bool = False,
            distinct: bool = False, kept: Broadcast | None = None) -> DataFrame:
    """(by, d, n), or (by, d, term, n), by language (`l`) or group (`g`): occurrences of each term, or (`once`) documents that hold it, by digest;
    `distinct`: only which terms there are, n is 1.

    A task adds up in tables of a bounded size before it hands on, so a term can be in several rows. With `kept`, the sorted
    digests of each language's kept terms, it hands on those alone."""
    names = [by, "d", *(["term"] if strings else []), "n"]

    def rows(lang: int, group: int, held: Counter | set) -> Iterator[pa.RecordBatch]:
        d = np.fromiter(map(digest, held), np.uint64, len(held)).view(np.int64)
        n = np.ones(len(held), np.int64) if distinct else np.fromiter(held.values(), np.int64, len(held))
        text = [pa.array(list(held), pa.binary())] if strings else []
        if kept is not None:
            own = kept.value.get(lang, np.zeros(0, np.int64))
            at = np.searchsorted(own, d)
            is_kept = at < len(own)
            is_kept[is_kept] = own[at[is_kept]] == d[is_kept]
            d, n, text = d[is_kept], n[is_kept], [x.filter(pa.array(is_kept)) for x in text]
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(d), group)), pa.array(d), *(x.cast(pa.string()) for x in text), pa.array(n)],
                                           names=names)
        yield from (whole.slice(at, 20_000) for at in range(0, len(d), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter | set] = defaultdict(set if distinct else Counter)
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for lang, group, text in zip(part.column("l").to_pylist(), part.column(by).to_pylist(), texts, strict=True):
                    terms = text.translate(_FOLD).split()
                    own = held[lang, group]
                    size -= len(own)
                    own.update(set(terms) if once else terms)
                    size += len(own)
                if size >= COUNTED:
                    for (lang, group), own in held.items():
                        yield from rows(lang, group, own)
                    held.clear()
                    size = 0
        for (lang, group), own in held.items():
            yield from rows(lang, group, own)

    return named.select("l", "g", "text").mapInArrow(run, f"{by} long, d long, {'term string, ' if strings else ''}n long")


def _digests_of(kept: DataFrame) -> Broadcast:
    """Sorted digests of each language's kept terms, for tasks; at most BROADCAST_TERMS."""
    whole = kept.select("l", "d").toArrow()
    langs, d = whole.column("l").to_numpy(), whole.column("d").to_numpy()
    return kept.sparkSession.sparkContext.broadcast({int(x): np.sort(d[langs == x]) for x in np.unique(langs)})


def _sum() -> Column:
    return F.sum("n").alias("n")


def kept_terms(named: DataFrame, groups: DataFrame, least: int = LEAST, digest: Digest = xxhash.xxh3_64_intdigest) -> tuple[DataFrame, DataFrame]:
    """(terms, counts): (l, d, k, term) of kept terms, and (g, l, d, k, n) of those that occur.

    (d, k) names a term of a language: k is 0 but for terms that share a digest."""
    held = counted(named, "l", digest, once=True)
    kept = materialize(held.groupBy(*_TERM).agg(_sum()).where(F.col("n") >= least).select(*_TERM), "op12-kept")
    # Few kept terms: tasks hand on nothing else; more are joined.
    few = _digests_of(kept) if kept.count() <= BROADCAST_TERMS else None
    of_kept = lambda df: df if few else df.join(kept, _TERM, "left_semi")
    spelled = counted(named, "l", digest, strings=True, distinct=True, kept=few)
    strings = materialize(of_kept(spelled).select(*_TERM, "term").distinct(), "op12-strings")
    # min and max tell whether a digest stands for one term
    shared = materialize(strings.groupBy(*_TERM).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).where("lo <> hi").select(*_TERM),
                         "op12-shared")
    lang_of = groups.select("g", "l")
    counts = of_kept(counted(named, "g", digest, kept=few).groupBy("g", "d").agg(_sum()).join(lang_of, "g"))
    name = F.lit(0).alias("k")
    if not shared.count():
        return strings.select(*_TERM, name, "term"), materialize(counts.select("g", *_TERM, name, "n"), "op12-counts")
    # Terms that share a digest: counted by their strings, kept by their own documents, numbered in a digest.
    again = counted(named, "l", digest, once=True, strings=True, kept=few).join(shared, _TERM, "left_semi").groupBy(*_TERM, "term").agg(_sum()).where(
        F.col("n") >= least)
    numbered = materialize(again.select(*_TERM, F.row_number().over(Window.partitionBy(*_TERM).orderBy("term")).alias("k"), "term"), "op12-split")
    by_term = counted(named, "g", digest, strings=True, kept=few).groupBy("g", "d", "term").agg(_sum()).join(lang_of, "g")
    terms = strings.join(shared, _TERM, "left_anti").select(*_TERM, name, "term").unionByName(numbered)
    split = by_term.join(numbered, [*_TERM, "term"]).select("g", *_TERM, "k", "n")
    whole = counts.join(shared, _TERM, "left_anti").select("g", *_TERM, name, "n")
    return materialize(terms, "op12-terms"), materialize(whole.unionByName(split), "op12-counts")


def frequency(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)); 1 in a language without kept terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1L + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(19, 0))) "
                  f"DIV CAST({total} + 2 * {terms} AS DECIMAL(20, 0)) ELSE 1L END")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q}))")


def group_sums(groups: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """`groups` with total, held, v, p0: occurrences of kept terms, how many the group holds, how many its language keeps, and
    the frequency of a term that it doesn't hold."""
    sums = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    kept = terms.groupBy("l").agg(F.count(F.lit(1)).alias("v"))
    return groups.join(sums, "g", "left").join(kept, "l", "left").na.fill(0, ["total", "held", "v"]).withColumn("p0", frequency("0", "total", "v"))


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h, value): the distance of every source of a language to every other, over all kept terms."""
    other = groups.select("l", F.col("g").alias("h"), F.col("held").alias("held_"), F.col("p0").alias("q0"))
    both = groups.join(other, "l").where("g <> h")
    base = both.select("g", "h", ((F.col("v") - F.col("held") - F.col("held_")) * distance("p0", "q0")).alias("value"))
    # Of one source alone: how many of its terms have which count.
    sizes = groups.select("g", "total", "v", "p0")
    histogram = counts.groupBy("g", "l", "n").agg(F.count(F.lit(1)).alias("m")).join(sizes, "g")
    alone = histogram.withColumn("p", frequency("n", "total", "v")).join(other, "l").where("g <> h").groupBy("g", "h").agg(
        F.sum(F.col("m") * distance("p", "q0")).alias("value"))
    # Of both: the sources that hold a term, joined on it and added up at once.
    own = counts.join(sizes, "g").withColumn("p", frequency("n", "total", "v"))
    left = own.select("d", "k", "l", "g", "p", "p0")
    right = own.select("d", "k", "l", F.col("g").alias("h"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    joint = left.join(right, ["d", "k", "l"]).where("g < h").groupBy("g", "h").agg(F.sum(
        distance("p", "q") - distance("p", "q0") - distance("p0", "q") + distance("p0", "q0")).alias("value"))
    turned = lambda df: df.select(F.col("h").alias("g"), F.col("g").alias("h"), "value")
    parts = base.unionByName(alone).unionByName(turned(alone)).unionByName(joint).unionByName(turned(joint))
    return parts.groupBy("g", "h").agg(F.sum("value").alias("value"))


def term_values(terms: DataFrame, counts: DataFrame, groups: DataFrame, listed: int = LISTED) -> DataFrame:
    """(g, item, value, rank): the terms that a source uses most beyond its language."""
    langs = groups.groupBy("l").agg(F.sum("total").alias("all_total"))
    sizes = groups.join(langs, "l").select("g", "total", "v", "all_total")
    own = counts.withColumn("all_n", F.sum("n").over(Window.partitionBy("d", "k", "l"))).join(sizes, "g")
    valued = own.withColumn("p", frequency("n", "total", "v")).withColumn("q", frequency("all_n", "all_total", "v")).where("p > q").select(
        "g", "l", "d", "k", distance("p", "q").alias("value"))
    by = Window.partitionBy("g")
    # All that tie with the last listed value stay until their strings decide.
    likely = valued.withColumn("rank", F.rank().over(by.orderBy(F.desc("value")))).where(F.col("rank") <= listed).drop("rank")
    return likely.join(terms, ["d", "k", "l"]).select("g", F.col("term").alias("item"), "value").withColumn(
        "rank", F.row_number().over(by.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= listed)


def audit(docs: DataFrame, least: int = LEAST, listed: int = LISTED, digest: Digest = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term`, ranks from 1 for each source and part."""
    occurring, seed = named_groups(docs)
    terms, counts = kept_terms(_named(docs, seed), occurring, least, digest)
    groups = materialize(group_sums(occurring, terms, counts), "op12-sums")
    pairs = pair_values(counts, groups).join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").withColumn(
        "rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item")))
    named = lambda df, part: df.select("g", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"),
                                       F.col("rank").cast("int").alias("rank"))
    both = named(pairs, "pair").unionByName(named(term_values(terms, counts, groups, listed), "term"))
    return both.join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tok AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
ltot AS (SELECT lang, sum(n) AS n FROM tot GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) AS p,
  1 + (1000000000::HUGEINT * (lc.n + 2)) // (lt.n + 2 * v.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) JOIN lc ON lc.lang = g.lang AND lc.term = k.term JOIN ltot lt ON lt.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
  WHERE rank <= {LISTED})
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
