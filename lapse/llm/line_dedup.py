"""Operator 1: repeated runs of lines, by a suffix array over line ids.

Every line gets an id; a text is a sequence of ids. Lines that occur once can't
be part of a repeated run, so they cut the texts into runs, and runs of too few
words go no further. Prefix doubling ranks the suffixes of what is left: from
ranks by the first w lines, a global sort of the tuples of ranks at 0, w, 2w and
3w gives those by the first 4w (two doublings a round), until no group of equal
suffixes splits. The last ranks are the inverse suffix array.

Suffixes that share their first l lines are one interval of the suffix array,
with a longest common prefix of at least l. The rank columns of all rounds name
such intervals: four ranks that cover l lines tell whether two suffixes share
them. A window of at least `min_words` words is deleted where its interval holds
an earlier suffix. Only windows up to where the next start's shortest one ends
are looked at, 2 for each line in all: what is longer is their union. So each
copy but the first of every maximal repeated run of `min_words` words is
deleted, and each deleted line still stands at an earlier place.

Order of copies: by doc_id (nulls first), then hash of the text, then line.
A text of any length is cut into rows of lines; a run of repeated lines is an array of one row.
Null text: as empty; it has one empty line and loses nothing. Rows of equal id
and text are one document: they lose the same lines, and are no copies of each
other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import SPACE, batches_of, packed, rows_of, texts
from lapse.operators.ordered import global_rank
from lapse.session import materialize

#: Least words of a repeated run that is deleted.
MIN_WORDS = 50
#: Most deleted stretches that are broadcast to the texts; beyond it, the join shuffles.
BROADCAST_STRETCHES = 500_000

_DOC = ["doc_id", "th"]


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("th", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h1, h2, n): every line with a 128-bit id and its words."""
    each = _keyed(docs).select(*_DOC, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return each.select(*_DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                       F.regexp_count("line", F.lit(SPACE.replace("[", "[^") + "+")).alias("n"))


def runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, run, pos, h1, h2, n): lines in stretches of repeated lines of `min_words` words at least."""
    # Written, so that both sides of the join are exchanges and adaptive execution can split a line that is everywhere.
    repeated = materialize(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("h1", "h2"), "op1-repeated")
    own = lines.join(repeated, ["h1", "h2"]).dropDuplicates([*_DOC, "pos"])
    order = Window.partitionBy(*_DOC).orderBy("pos")
    placed = own.withColumn("run", F.col("pos") - F.row_number().over(order))
    return placed.withColumn("words", F.sum("n").over(Window.partitionBy(*_DOC, "run"))).where(F.col("words") >= min_words).drop("words")


def _gathered(ranked: DataFrame, others: list[str]) -> DataFrame:
    """One row a run, with its places' values as arrays in order. Bounded by the run."""
    cols = ["pos", *others]
    rows = ranked.groupBy(*_DOC, "run").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    return rows.select(*_DOC, "run", *(F.col(f"x.{c}").alias(c) for c in cols))


def suffix_ranks(lines_in_runs: DataFrame) -> tuple[DataFrame, int]:
    """Runs (doc_id, th, run, pos, n, r0, r1, ...) as arrays, and the number of rank columns: rk ranks suffixes by
    their first 4^k lines, a run's end before any line; the last is the inverse suffix array."""
    ids = materialize(global_rank(lines_in_runs.select("h1", "h2").distinct(), [F.col("h1"), F.col("h2")], "r0"), "op1-ids")
    table = materialize(_gathered(lines_in_runs.join(ids, ["h1", "h2"]), ["n", "r0"]), "op1-ranks")
    groups, level = ids.count(), 0
    while groups:
        wide = 4**level
        tuples = table.select(*_DOC, "run", F.posexplode(f"r{level}").alias("at", "a"), F.col(f"r{level}").alias("rs")).select(
            *_DOC, "run", "at", "a", *(F.coalesce(F.get("rs", F.col("at") + j * wide), F.lit(0)).alias(c) for j, c in ((1, "b"), (2, "c"), (3, "d"))))
        key = ["a", "b", "c", "d"]
        distinct = materialize(global_rank(tuples.select(*key).distinct(), [F.col(c) for c in key], "r"), "op1-tuples")
        now = distinct.count()
        if now == groups:
            break
        level += 1
        new = tuples.join(distinct, key).groupBy(*_DOC, "run").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("x")).select(
            *_DOC, "run", F.col("x.r").alias(f"r{level}"))
        table, groups = materialize(table.join(new, [*_DOC, "run"]), "op1-ranks"), now
    return table, level + 1


def windows(table: DataFrame, levels: int, min_words: int) -> DataFrame:
    """(doc_id, th, start, lines, a, b, c, d): windows of `min_words` words at least; lines and four ranks name the
    interval of suffixes that begin with the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for i, th, pos, n, *ranks in rows_of(batches, "doc_id", "th", "pos", "n", *(f"r{k}" for k in range(levels))):
                words = np.concatenate([[0], np.cumsum(n)])
                # The first end of a window of enough words from each start; one more place if there is none.
                ends = np.searchsorted(words, words[:-1] + min_words).tolist() + [len(n) + 1]
                for s in range(len(n)):
                    if ends[s] > len(n):
                        break
                    for e in range(max(ends[s], s + 1), max(ends[s], s + 1, min(ends[s + 1] - 1, len(n))) + 1):
                        yield i, th, pos[s], e - s, *name(ranks, s, e)

        def name(ranks: list[list[int]], s: int, e: int) -> tuple[int, int, int, int]:
            k = 0
            while k + 1 < levels and 4 ** (k + 1) <= e - s:
                k += 1
            r, wide = ranks[k], 4**k
            if 4 * wide <= e - s:  # past the last round, equal ranks mean equal suffixes to the run's end
                return r[s], 0, 0, 0
            last = e - wide
            return r[s], *(r[min(s + j * wide, last)] for j in (1, 2)), r[last]

        yield from batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("lines", pa.int32()),
                                                 *((c, pa.int64()) for c in "abcd")]), 10_000)

    return table.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, th long, start int, lines int, a long, b long, c long, d long")


def stretches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, start, end): maximal stretches of deleted lines, end exclusive."""
    in_runs = materialize(runs(materialize(line_table(docs), "op1-lines"), min_words), "op1-runs")
    table, levels = suffix_ranks(in_runs)
    found = materialize(windows(table, levels, min_words), "op1-windows")
    key = ["lines", "a", "b", "c", "d"]
    place = F.struct(*_DOC, "start")
    first = materialize(found.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("f")).where("f > 1").drop("f"), "op1-first")
    later = found.join(first, key).where(~place.eqNullSafe(F.col("first"))).select(
        *_DOC, "start", (F.col("start") + F.col("lines")).alias("end"))
    order = Window.partitionBy(*_DOC).orderBy("start", "end")
    reach = later.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*_DOC, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*_DOC, "start", "end")


def with_deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(whole, deleted, lines): each row of `docs` as one column, the stretches (start, end) of lines that it loses,
    and its lines."""
    deleted = materialize(stretches(docs, min_words), "op1-stretches")
    n = deleted.count()
    by_doc = deleted.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("deleted"))
    small = F.broadcast(by_doc) if n <= BROADCAST_STRETCHES else by_doc
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = packed(docs).join(small, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return joined.select("whole", F.coalesce("deleted", none).alias("deleted")).withColumn(
        "lines", F.split(F.coalesce("whole.text", F.lit("")), "\n"))


def kept_text(lines: Column, deleted: Column) -> Column:
    """The lines outside the deleted stretches, joined again."""
    at = F.concat(F.array(F.lit(0)), F.transform(deleted, lambda x: x["end"]))
    to = F.concat(F.transform(deleted, lambda x: x["start"]), F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(at, to, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies of repeated runs deleted from `text`; rows that lose nothing stay as they are, and
    n_chars, if there, follows."""
    loses = F.size("deleted") > 0
    text = F.when(loses, kept_text(F.col("lines"), F.col("deleted"))).otherwise(F.col("whole.text"))
    own = with_deletions(docs, min_words).withColumn("kept", text)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(loses, F.length("kept").cast(kind)).otherwise(F.col("whole.n_chars"))
    return own.select(*(new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, deleted, kept_sha256): deleted stretches as start:end, and the text that is left."""
    own = with_deletions(texts(docs), min_words)
    gone = F.aggregate("deleted", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    kept = F.when(F.size("deleted") > 0, kept_text(F.col("lines"), F.col("deleted"))).otherwise(F.col("whole.text"))
    spans = F.transform("deleted", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return own.select("whole.doc_id", F.size("lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"),
                      F.array_join(spans, ",").alias("deleted"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos + 1] AS line, len(list_filter(string_split_regex(ls[pos + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM d)),
c AS (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS w, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS z FROM l),
q AS (SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.z - a.w >= {MIN_WORDS} GROUP BY 1, 2),
x AS (SELECT q.doc_id, q.s, q.e, coalesce(lead(q.e) OVER (PARTITION BY q.doc_id ORDER BY q.s), len(d.ls) + 1) AS f FROM q JOIN d USING (doc_id)),
w AS (SELECT doc_id, s, unnest(range(e, greatest(e, f - 1) + 1)) AS e FROM x),
t AS (SELECT w.doc_id, s, e, d.ls[s + 1:e] AS ls FROM w JOIN d USING (doc_id)),
m AS (SELECT ls, min((doc_id, s)) AS first FROM t GROUP BY ls HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS pos FROM t JOIN m USING (ls) WHERE (doc_id, s) <> first),
i AS (SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM g) GROUP BY doc_id, k),
o AS (SELECT doc_id, sum(e - s) AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS x FROM i GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS t FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(o.n, 0)::BIGINT AS n_deleted, coalesce(o.x, '') AS deleted, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)
"""
