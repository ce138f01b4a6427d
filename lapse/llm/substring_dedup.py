"""Operator 11: removal of long repeated passages by recompression.

A text's words are symbols. A round first names maximal runs of one symbol, then
pairs: a hash of name and round deals all symbols into left and right ones, and
each left one followed by a right one becomes a pair. A name is a hash of what
it stands for, so that every task gives the same name without a table of names.
Where a passage occurs twice, both occurrences get the same names inside; only
symbols at the edges depend on the neighbours. How far that reaches is followed
window by window, in terms of the window's own words alone: a first or last run
may go on outside, a first right symbol or last left one may pair outside.

So a window's symbols that don't depend on its neighbours are the same wherever
it occurs. The longest of them (then by hash, then the first) is its anchor; a
window that has none (a run of one word) is its own. Neighbouring windows of one
anchor form a stretch: about one for 15 words. Spark rounds then name globally:

1. anchors: the least and greatest doc_id of each; an anchor of one document
   reveals no repeat, and its windows are done.
2. stretches of shared anchors, by a 128-bit digest of all their words: a stretch
   that also occurs in an earlier document is removed whole.
3. windows, by digests of their 50 words, where an anchor has several stretches,
   and only in the earliest document of each: the edges of repeats, verified.

Each round is an aggregation (added up in a task before the shuffle), joined back
with a written table, so that a hot passage's partition can be split.

Null text: no words. A row whose doc_id is null loses nothing and takes nothing
from others; rows of one doc_id are one document and take nothing from each
other, repeated rows lose alike. Ties don't arise. Long texts are parsed in
overlapping segments of bounded size. An empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import texts, words
from lapse.session import materialize

#: Words of a window, and rounds of recompression.
WINDOW, ROUNDS = 50, 4
#: Words that are parsed at once; a longer text goes in segments that overlap by a window less a word.
SEGMENT = 1 << 16
#: Most shared anchors, and most documents, whose keys are broadcast; beyond it, joins shuffle.
BROADCAST_ANCHORS, BROADCAST_DOCS = 1_000_000, 1_000_000
#: Words whose hashes a worker remembers.
MEMO = 300_000

_DOC = ["doc_id", "th"]
_CLASS = ["anchor", "da", "db"]
_BASES = tuple((x, pow(x, -1, 1 << 64)) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
_C1, _C2, _C3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(of: int, n: int) -> np.ndarray:
    """Powers 0 to n of a number modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, of, np.uint64)]))


class Digests:
    """Digests of slices of a sequence of word hashes, from prefix sums of two polynomials modulo 2^64."""

    def __init__(self, h: np.ndarray) -> None:
        self.sums, self.back = [], []
        size = max(2 * (SEGMENT + WINDOW), 1 << len(h).bit_length())  # so that most blocks share their powers
        for base, inverse in _BASES:
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, size)[: len(h)], dtype=np.uint64)]))
            self.back.append(_powers(inverse, size))

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of each slice."""
        n = (end - start).astype(np.uint64)
        return tuple(_mix(((s[end] - s[start]) * b[start]) ^ (n * _C3)) for s, b in zip(self.sums, self.back, strict=True))


def parse(h: np.ndarray, own: np.ndarray, start: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, first, lo, hi): the symbols after `rounds` rounds, the word each begins at, and for every window (by the word
    it starts at) the symbols lo to hi (exclusive) that don't depend on its neighbours; none if lo >= hi. `own` numbers
    the texts that the words belong to; no symbol spans two."""
    names, first = h, np.arange(len(h))
    lo, hi = start, start + window
    for r in range(rounds):
        # Runs.
        new = np.ones(len(names), dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (own[1:] != own[:-1])
        run, at = np.cumsum(new) - 1, np.flatnonzero(new)
        length = np.diff(np.append(at, len(names))).astype(np.uint64)
        names, first, own = np.where(length > 1, _mix(names[at] + length * _C3), names[at]), first[at], own[at]
        lo, hi = _inside(lo, hi, run[np.minimum(lo, len(run) - 1)] + 1, run[hi - 1])
        # Pairs.
        right = (_mix(names ^ np.uint64((r + 1) * int(_C2) % (1 << 64))) >> np.uint64(63)).astype(bool)
        second = np.zeros(len(names), dtype=bool)
        second[1:] = ~right[:-1] & right[1:] & (own[1:] == own[:-1])
        index, at = np.cumsum(~second) - 1, np.flatnonzero(~second)
        paired = np.append(second[1:], False)[at]
        after = names[np.minimum(at + 1, len(names) - 1)]
        a, b = np.minimum(lo, len(names) - 1), np.maximum(hi - 1, 0)
        lo, hi = _inside(lo, hi, index[a] + right[a], index[b] + right[b])
        names, first, own = np.where(paired, _mix(names[at] * _C1 + _mix(after ^ _C3)), names[at]), first[at], own[at]
    return names, first, lo, hi


def _inside(lo: np.ndarray, hi: np.ndarray, new_lo: np.ndarray, new_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New bounds where the old ones hold a symbol; else an empty range at the start, which stays empty."""
    some = (lo < hi) & (new_lo < new_hi)
    return np.where(some, new_lo, 1), np.where(some, new_hi, 1)


def _greatest(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the greatest value in [lo, hi), the first of equals."""
    best, out, width = np.arange(len(value)), np.zeros(len(lo), dtype=np.int64), 1
    size = hi - lo
    while len(lo) and width <= size.max():
        fits = (size >= width) & (size < 2 * width)
        a, b = best[lo[fits]], best[hi[fits] - width]
        out[fits] = np.where(value[a] >= value[b], a, b)
        a, b = best[: max(len(best) - width, 0)], best[width:]
        best, width = np.where(value[a] >= value[b], a, b), 2 * width
    return out


def stretches_of(h: np.ndarray, own: np.ndarray, start: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(anchor, da, db, first, n): stretches of `n` windows from the one at word `first`, digests over all their words."""
    digests = Digests(h)
    names, at, lo, hi = parse(h, own, start, window, rounds)
    length = np.diff(np.append(at, len(h))).astype(np.uint64)
    value = (np.minimum(length, np.uint64(window)) << np.uint64(48)) | (_mix(names) >> np.uint64(16))
    some = lo < hi
    anchor = np.full(len(start), -1)
    anchor[some] = _greatest(value, lo[some], hi[some])
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (start[1:] != start[:-1] + 1)
    i = np.flatnonzero(new)
    first, n = start[i], np.diff(np.append(i, len(start)))
    da, db = digests.of(first, first + n - 1 + window)
    # A window without an anchor is its own.
    return np.where(anchor[i] < 0, _mix(da ^ _C2), names[np.maximum(anchor[i], 0)]), da, db, first, n


def _hashes(text: bytes, memo: _WordHashes) -> np.ndarray:
    found = text.split()  # splits at space and tab to carriage return, as the contract's words do
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def _rows(batch: pa.RecordBatch, *others: str) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(),
                       *(part.column(c).to_pylist() for c in others), strict=True)


_SIGNED = ("anchor", "da", "db")


def stretch_table(own: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, anchor, da, db, first, n): the stretches of all texts of `window` words or more."""
    names = [*_DOC, *_SIGNED, "first", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        held: list[tuple[int, int, int, np.ndarray]] = []  # id, text hash, words before, hashes
        size = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(h) for *_, h in held])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            which = np.repeat(np.arange(len(held)), sizes)
            place = np.arange(sizes.sum()) - at[which]
            start = np.flatnonzero(place + window <= sizes[which])
            anchor, da, db, first, n = stretches_of(np.concatenate([h for *_, h in held]), which, start, window, rounds)
            doc = which[first]
            of = lambda c: np.array([x[c] for x in held], dtype=np.int64)[doc]
            columns = [of(0), of(1), *(x.view(np.int64) for x in (anchor, da, db)), first - at[doc] + of(2), n]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, th, text in _rows(batch):
                h = _hashes(text, memo)
                for before in range(0, len(h) - window + 1, SEGMENT):
                    held.append((doc_id, th, before, h[before : before + SEGMENT + window - 1]))
                    size += len(held[-1][3])
                    if size >= SEGMENT:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return own.mapInArrow(run, "doc_id long, th long, anchor long, da long, db long, first int, n int")


def window_table(own: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, wa, wb, at): digests of the windows of each text's `open` stretches (first, n)."""
    names, kinds = [*_DOC, "wa", "wb", "at"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for doc_id, th, text, stretches in _rows(batch, "open"):
                h = _hashes(text, memo)
                for s in stretches:
                    for first in range(s["first"], s["first"] + s["n"], SEGMENT):
                        n = min(SEGMENT, s["first"] + s["n"] - first)
                        at = np.arange(n)
                        wa, wb = Digests(h[first : first + n + window - 1]).of(at, at + window)
                        columns = [np.full(n, doc_id), np.full(n, th), wa.view(np.int64), wb.view(np.int64), at + first]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return own.mapInArrow(run, "doc_id long, th long, wa long, wb long, at int")


def _keyed(docs: DataFrame) -> DataFrame:
    own = texts(docs)
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, start, end): places of words that a window of an earlier document covers, end exclusive; they may overlap."""
    own = _keyed(docs).where("doc_id IS NOT NULL")
    stretches = materialize(stretch_table(own, window, rounds), "op11-stretches")
    # 1. Anchors that occur in two documents.
    shared = materialize(stretches.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"),
                         "op11-anchors")
    few = shared.count() <= BROADCAST_ANCHORS
    likely = materialize(stretches.join(F.broadcast(shared) if few else shared, "anchor", "left_semi"), "op11-likely")
    # 2. Stretches of theirs: whole ones go where an earlier document has them.
    classes = materialize(likely.groupBy(*_CLASS).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "op11-classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")  # some of `shared`
    named = materialize(likely.join(classes.where("lo < hi").select(*_CLASS, "lo"), _CLASS, "left").withColumn("later", F.coalesce(
        F.col("doc_id") > F.col("lo"), F.lit(False))).drop("lo"), "op11-named")
    whole = named.where("later").select(*_DOC, F.col("first").alias("start"), (F.col("first") + F.col("n") + window - 1).alias("end"))
    # 3. Windows of the others, where an anchor has several stretches.
    left = named.where("NOT later").join(F.broadcast(several) if few else several, "anchor", "left_semi").select(*_DOC, "first", "n").distinct()
    by_doc = materialize(left.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "n")).alias("open")), "op11-open")
    small = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_DOCS else by_doc
    windows = materialize(window_table(own.join(small, _DOC), window), "op11-windows")
    first = materialize(windows.groupBy("wa", "wb").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(
        "wa", "wb", "lo"), "op11-first")
    edges = windows.join(first, ["wa", "wb"]).where("doc_id > lo").select(*_DOC, F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    return whole.unionByName(edges)


def _islands(places: DataFrame) -> DataFrame:
    """(doc_id, th, start, end): the union of overlapping or touching places, apart and in order."""
    order = Window.partitionBy(*_DOC).orderBy("start", "end")
    reach = places.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*_DOC, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def kept_words(ws: Column, gone: Column) -> Column:
    """The words outside the places that go."""
    at = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x["end"]))
    to = F.concat(F.transform(gone, lambda x: x["start"]), F.array(F.size(ws)))
    return F.flatten(F.zip_with(at, to, lambda a, b: F.slice(ws, a + 1, b - a)))


def deduplicated(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text, words, gone): every row's words and the places (start, end) that it loses, in order."""
    islands = _islands(removed(docs, window, rounds))
    by_doc = materialize(islands.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone")), "op11-gone")
    small = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_DOCS else by_doc
    none = F.array().cast("array<struct<start:int,end:int>>")
    return _keyed(docs).join(small, _DOC, "left").select("doc_id", "text", words(F.col("text")).alias("words"), F.coalesce("gone", none).alias("gone"))


def report(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row for each row of `docs`."""
    own = deduplicated(docs, window, rounds).withColumn("kept", F.when(F.size("gone") > 0, kept_words(F.col("words"), F.col("gone"))).otherwise(F.col("words")))
    return own.select("doc_id", F.size("words").cast("long").alias("n_words"), (F.size("words") - F.size("kept")).cast("long").alias("n_removed"),
                      F.sha2(F.array_join("kept", " "), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, i, hash(ws[i:i + {WINDOW - 1}]) AS h FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
c AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
x AS (SELECT w.r, w.doc_id, w.i, d.ws[w.i:w.i + {WINDOW - 1}] AS k FROM w JOIN c USING (h) JOIN d ON d.r = w.r),
m AS (SELECT k, min(doc_id) AS lo FROM x GROUP BY k),
g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM x JOIN m USING (k) WHERE x.doc_id > m.lo),
s AS (SELECT r, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT s.r, count(*) AS n, string_agg(word, ' ' ORDER BY s.p) AS t FROM s ANTI JOIN g ON g.r = s.r AND g.p = s.p GROUP BY s.r)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
