"""Operator 13: ranked lexical search by hashed max-sketches.

A term's impact in a document depends on the document alone: (10^9 * tf) div
(1000 * tf + 12 * m). A document's sketch has one coordinate for each value of a
hash of its terms and keeps the largest impact there. A query's terms look their
coordinates up, all documents of a block at once: the sum of weight times
coordinate is never less than the score. Documents are then rescored exactly by
descending bound, until the next bound can't reach the query's k-th best score;
that score is carried from block to block of a task. Each task hands on its k
best documents of each query; a window per query picks from those.

Two passes over the texts: counts (documents, terms, documents that hold each
query term; added up in a task before the shuffle), then sketches. Queries are
broadcast in batches of a bounded number of terms, one pass each.

Null or empty text: no terms, never found, in no count. An item without terms
finds nothing. Items of equal id and text are one; different texts of one id are
ranked each. Rows are ranked each, also repeated ones; a null doc_id is ranked,
after others of its score. Equal scores: by doc_id. Empty tables give an empty
result; a text of any length is one row of terms. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, texts
from lapse.session import materialize

#: Documents that a query returns.
BEST = 20
#: Coordinates of a sketch, and documents whose sketches are held at once.
WIDE, BLOCK = 4096, 512
#: Most terms (with repeats) of the queries that are broadcast at once.
BATCH_TERMS = 200_000
#: Words whose coordinates a worker remembers.
MEMO = 300_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Separators to spaces and A-Z to a-z; bytes from 0x80 on, i.e. all of a character that isn't ASCII, stay.
_FOLD = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

Query = tuple[int, list[tuple[bytes, int]]]


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split()


def query_table(items: DataFrame) -> DataFrame:
    """(q, item_id, text): distinct items, numbered by a hash of id and text."""
    own = items.select(items["item_id"], F.coalesce(items["text"], F.lit("")).alias("text")).distinct()
    return own.select(F.xxhash64("item_id", "text").alias("q"), "item_id", "text")


def query_batches(queries: DataFrame) -> Iterator[list[Query]]:
    """Queries as (q, [(term, repeats)]), in batches of at most BATCH_TERMS terms, or one query."""
    held: list[Query] = []
    size = 0
    for r in queries.select("q", "text").toLocalIterator():  # a partition at a time
        found = Counter(terms_of(r["text"].encode()))
        n = sum(found.values())
        if not n:
            continue
        if held and size + n > BATCH_TERMS:
            yield held
            held, size = [], 0
        held.append((r["q"], sorted(found.items())))
        size += n
    if held:
        yield held


def _bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for at in range(0, batch.num_rows, 256):
        yield from batch.column(column).slice(at, 256).cast(pa.binary()).to_pylist()


def corpus_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """(N, L, df): documents with a term, all terms, and documents that hold each term of `vocabulary` by its number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n, total = shared.value, 0, 0
        held: Counter = Counter()
        for batch in batches:
            for text in _bytes(batch, "text"):
                found = terms_of(text)
                n, total = n + bool(found), total + len(found)
                held.update(numbers.keys() & found)
        rows = iter([(-2, n), (-1, total), *((numbers[t], k) for t, k in held.items())])
        yield from batches_of(rows, pa.schema([("t", pa.int64()), ("n", pa.int64())]), 20_000)

    counted = texts(docs).select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    of = {r["t"]: r["n"] for r in counted.collect()}  # at most the batch's terms
    return of.pop(-2, 0), of.pop(-1, 0), of


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, total: int) -> int:
    return 100 - 25 + (25 * n * n_docs) // total


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Coordinates(dict):
    """Sketch coordinates of terms; a bounded number of them remembered."""

    def __init__(self, wide: int) -> None:
        super().__init__()
        self.wide = wide

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[term] = at = xxhash.xxh3_64_intdigest(term) % self.wide
        return at


class _Block:
    """Documents whose sketches are looked up together."""

    def __init__(self, wide: int) -> None:
        self.wide = wide
        self.ids: list[int | None] = []
        self.factors: list[int] = []
        self.counts: list[dict[bytes, int]] = []
        self.at: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def add(self, doc_id: int | None, counts: Counter, m: int, coordinates: _Coordinates, wanted: dict[bytes, int]) -> None:
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.at.append(np.fromiter(map(coordinates.__getitem__, counts), np.int64, len(counts)))
        self.value.append((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        self.counts.append({t: counts[t] for t in counts.keys() & wanted.keys()})  # all that an exact score reads
        self.ids.append(doc_id)
        self.factors.append(m)

    def sketches(self) -> np.ndarray:
        """(coordinate, document): the largest impact at each coordinate."""
        out = np.zeros((self.wide, len(self.ids)), dtype=np.float32)  # impacts are below 2^24: exact
        rows = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.at])
        np.maximum.at(out, (np.concatenate(self.at), rows), np.concatenate(self.value).astype(np.float32))
        return out


def _order(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def best_of_task(batches: Iterator[pa.RecordBatch], queries: list[Query], weights: dict[bytes, int], n_docs: int, total: int,
                 best: int, wide: int, rescored: Counter | None = None) -> Iterator[tuple[int, int | None, int]]:
    """(q, doc_id, score) of the `best` documents of each query among the rows of a task."""
    coordinates = _Coordinates(wide)
    lookup = [(np.array([coordinates[t] for t, _ in ts], dtype=np.int64), np.array([weights[t] * k for t, k in ts], dtype=np.float32),
               [(t, weights[t] * k) for t, k in ts]) for _, ts in queries]
    # The documents kept for a query, best first, as (-score, id order, id).
    kept: list[list[tuple]] = [[] for _ in queries]

    def flush(block: _Block) -> None:
        sketch = block.sketches()
        for held, (at, w, exact) in zip(kept, lookup, strict=True):
            # A float32 sum of n terms is off by n * 2^-24 of itself at most; the bound is rounded up by more.
            bound = (w @ sketch[at]) * np.float32(1 + 1e-6 * (len(at) + 8))
            least = -held[-1][0] if len(held) == best else 1
            likely = np.flatnonzero(bound >= least)
            for i in likely[np.argsort(-bound[likely], kind="stable")].tolist():
                if len(held) == best and bound[i] < -held[-1][0]:
                    break
                counts, m = block.counts[i], block.factors[i]
                score = sum(x * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, x in exact if t in counts)
                if rescored is not None:
                    rescored["documents"] += 1
                row = (-score, _order(block.ids[i]), block.ids[i])
                if score > 0 and (len(held) < best or row < held[-1]):
                    held.append(row)
                    held.sort(key=lambda r: r[:2])
                    del held[best:]

    block = _Block(wide)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, _bytes(batch, "text"), strict=True):
            found = terms_of(text)
            if found:
                block.add(doc_id, Counter(found), length_factor(len(found), n_docs, total), coordinates, weights)
            if len(block.ids) == BLOCK:
                flush(block)
                block = _Block(wide)
    if block.ids:
        flush(block)
    for (q, _), held in zip(queries, kept, strict=True):
        for score, _, doc_id in held:
            yield q, doc_id, -score


def search(docs: DataFrame, items: DataFrame, best: int = BEST, wide: int = WIDE) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0."""
    spark = docs.sparkSession
    queries = materialize(query_table(items), "op13-queries")
    own = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], "q long, doc_id long, score long")
    for batch in query_batches(queries):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in batch for t, _ in ts}))}
        n_docs, total, df = corpus_counts(docs, vocabulary)
        weights = {t: weight(n_docs, df[i]) for t, i in vocabulary.items() if i in df}
        # Terms that no document holds score nothing.
        shared = spark.sparkContext.broadcast(([(q, [(t, k) for t, k in ts if t in weights]) for q, ts in batch], weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, total=total) -> Iterator[pa.RecordBatch]:
            rows = best_of_task(batches, *shared.value, n_docs, total, best, wide)
            yield from batches_of(rows, pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]), 20_000)

        found = found.unionByName(own.mapInArrow(run, "q long, doc_id long, score long"))
    # A task hands on `best` rows a query at most, and the window keeps as many before it shuffles.
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= best).join(queries.select("q", "item_id"), "q").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT item_id, term, count(*) AS k FROM i GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM d WHERE len(ts) > 0),
tok AS (SELECT r, unnest(ts) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, c.n),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ts) * c.n) // c.l AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT qt.item_id, tf.r, m.doc_id, sum(qt.k * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}
"""
