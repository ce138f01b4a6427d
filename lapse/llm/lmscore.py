"""Operator 9: scoring by cross-entropy difference.

Two bigram models over one vocabulary, smoothed alike: the target model counts
the documents that `labels` call good and not toxic, the background model all
others, scaled to the target's mass. A document's score is the mean over its
tokens of the background's less the target's log probability loss, so that
higher is nearer to the target.

The vocabulary is every word of the corpus. Words are 64-bit hashes. Texts are
read once and written as chunks of documents, their tokens numbered within the
chunk. Each chunk sends its own counts of bigrams and of words to buckets of
their keys; a bucket adds them up over all chunks and sends each chunk the totals
of what it sent, in the order in which it came, so that they need no keys. A
chunk holds a key once: hot words and bigrams are not skewed. Losses are whole
billionths: sums don't depend on order. With `n_words`, only so many of the most
frequent words are told apart and all others share one entry.

A text of any length is one list of tokens in its task. Null or empty text: no tokens, scores 0. A document without a label belongs to
the background; one labelled more than once is good if its worst label is.
Repeated rows count and score each; an empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, rows_of, short_batches, texts
from lapse.session import materialize

#: Weight of the unigram model in a context, in tokens.
PRIOR = 20.0
COUNTED = 200_000
#: Word hashes that a task remembers.
REMEMBERED = 300_000
#: Most ids of target documents that are broadcast.
BROADCAST_IDS = 2_000_000
#: Unit of a loss.
UNIT = 1e-9
#: Tokens after which a task begins another chunk; tokens of the corpus for each bucket of keys.
CHUNK = 1 << 20
BUCKET = 1 << 21
START, OTHER = 0, 1
#: Kinds of keys, by their number of counts.
BIGRAM, WORD = 2, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts; a task adds up before it hands on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: Counter = Counter()
            for (text,) in rows_of(batches, "text"):
                held.update(split(text))
                if len(held) >= COUNTED:
                    yield from held.items()
                    held.clear()
            yield from held.items()

        yield from batches_of(rows(), pa.schema([("word", pa.string()), ("n", pa.int64())]), 20_000)

    return texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, n: int) -> list[str]:
    return [r["word"] for r in word_counts(docs).orderBy(F.desc("n"), "word").limit(n).select("word").collect()]


class Numbers(dict):
    """Numbers of words: of a given vocabulary (all others are OTHER), else 64-bit hashes, a bounded number of them remembered."""

    def __init__(self, words: dict[str, int] | None) -> None:
        super().__init__(words or {})
        self.hashing = words is None

    def __missing__(self, word: str) -> int:
        if not self.hashing:
            return OTHER
        if len(self) >= REMEMBERED:
            self.clear()
        found = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        self[word] = found
        return found


def good_documents(labels: DataFrame) -> DataFrame:
    return labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        (F.coalesce(F.min("quality") == 1, F.lit(False)) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("target"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys of numbers, one each, spread over the whole range."""
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: high bytes that are alike cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def chunks(flagged: DataFrame, words: list[str] | None) -> DataFrame:
    """(chunk, t, o, ids, target, sizes, n, tokens, m, words): documents of a task, some `CHUNK` tokens a row, long texts more.

    `t` and `o` count the tokens of target and of other documents, `sizes` each document's with its START. `tokens` are the
    documents' one after another, as places in `words`, the numbers of the chunk's words, frequent ones first."""
    shared = flagged.sparkSession.sparkContext.broadcast(None if words is None else {w: i + 2 for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = Numbers(shared.value), itertools.count(TaskContext.get().partitionId() << 32)

        def chunk(held: list[tuple]) -> tuple:
            ids, target, lists = zip(*held, strict=True)
            sizes = np.array([len(x) for x in lists])
            found, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            t, o = (int((sizes - 1)[np.array(target) == x].sum()) for x in (True, False))
            return next(made), t, o, ids, target, sizes, len(at), pack(place[at]), len(found), pack(found[order])

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            size = 0
            for doc_id, target, text in rows_of(batches, "doc_id", "target", "text"):
                held.append((doc_id, target, np.array([START, *map(number.__getitem__, split(text))], dtype=np.int64)))
                size += len(held[-1][2])
                if size >= CHUNK:
                    yield chunk(held)
                    held, size = [], 0
            if held:
                yield chunk(held)

        yield from batches_of(rows(), schema, 1)

    schema = pa.schema([("chunk", pa.int64()), ("t", pa.int64()), ("o", pa.int64()), ("ids", pa.list_(pa.int64())), ("target", pa.list_(pa.bool_())),
                        ("sizes", pa.list_(pa.int32())), ("n", pa.int32()), ("tokens", pa.binary()), ("m", pa.int32()), ("words", pa.binary())])
    return flagged.select("doc_id", "target", "text").mapInArrow(run, "chunk long, t long, o long, ids array<long>, target array<boolean>, "
                                                                 "sizes array<int>, n int, tokens binary, m int, words binary")


class Bigrams:
    """The distinct bigrams of a chunk, by ascending key: `keys`, and of each the places `a` and `b` of its words.

    `at` are the tokens that follow another one of their document and `of` their bigrams; `order` sorts the words by key."""

    def __init__(self, sizes: list[int], n: int, tokens: bytes, m: int, words: bytes) -> None:
        tokens, words = unpack(tokens, np.uint32, n).astype(np.int64), unpack(words, np.int64, m).view(np.uint64)
        self.ends = np.cumsum(sizes)
        inside = np.ones(n, bool)
        inside[self.ends - sizes] = False
        self.at = np.flatnonzero(inside)
        self.before, self.own = tokens[self.at - 1], tokens[self.at]
        self.keys, first, self.of = np.unique(mixed(words[self.before] * _MIX + words[self.own]), return_index=True, return_inverse=True)
        self.a, self.b = self.before[first], self.own[first]
        self.word_keys = mixed(words)
        self.order = np.argsort(self.word_keys)

    def counts(self, target: list[bool], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, keys, counts): bigrams' occurrences in target and in other documents; words' likewise, and as contexts."""
        flags = np.repeat(np.array(target, bool), sizes)[self.at]

        def sides(x: np.ndarray, n: int) -> list[np.ndarray]:
            t = np.bincount(x[flags], minlength=n)
            return [t, np.bincount(x, minlength=n) - t]

        n = len(self.order)
        yield BIGRAM, self.keys, np.array(sides(self.of, len(self.keys)))
        yield WORD, self.word_keys[self.order], np.array([*sides(self.own, n), *sides(self.before, n)])[:, self.order]


_CHUNK = ("sizes", "n", "tokens", "m", "words")


def shares(table: DataFrame, bits: int) -> DataFrame:
    """(chunk, kind, bucket, n, keys, counts): a chunk's counts of bigrams and of words, dealt by the highest `bits` of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

        def rows() -> Iterator[tuple]:
            for chunk, target, sizes, *rest in (x for b in batches for i in range(b.num_rows) for x in rows_of([b.slice(i, 1)], "chunk", "target", *_CHUNK)):
                for kind, keys, counts in Bigrams(sizes, *rest).counts(target, sizes):
                    ends = [0, *np.searchsorted(keys, edges), len(keys)]
                    for bucket, (lo, hi) in enumerate(itertools.pairwise(ends)):
                        if lo < hi:
                            yield (chunk, kind, bucket, hi - lo, pack(np.diff(keys[lo:hi], prepend=np.uint64(0))),
                                   pack(counts[:, lo:hi].astype(np.uint32).ravel()))

        yield from batches_of(rows(), schema, 16)

    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    return table.select("chunk", "target", *_CHUNK).mapInArrow(run, "chunk long, kind int, bucket int, n int, keys binary, counts binary")


def totals(parts: DataFrame) -> DataFrame:
    """(chunk, kind, bucket, n, counts, new): for every chunk's share the counts of its keys over all chunks, in its order.
    `new` adds up to the distinct words that follow another token."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        kind, sizes = key[0].as_py(), part.column("n").to_pylist()
        ends = np.cumsum(sizes)
        keys = np.concatenate([np.cumsum(unpack(x, np.uint64, n)) for x, n in zip(part.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([unpack(x, np.uint32, n * kind).reshape(kind, n) for x, n in zip(part.column("counts").to_pylist(), sizes, strict=True)], axis=1)
        distinct, of = np.unique(keys, return_inverse=True)
        # Weights are doubles: exact to 2^53.
        whole = np.array([np.bincount(of, weights=c, minlength=len(distinct)) for c in counts]).astype(np.int64)
        new = int(np.count_nonzero(whole[0] + whole[1])) if kind == WORD else 0
        back = [pack(whole[:, of[hi - n:hi]].ravel()) for hi, n in zip(ends, sizes, strict=True)]
        return pa.table([part.column("chunk"), part.column("kind"), part.column("bucket"), part.column("n"), pa.array(back, pa.binary()),
                         pa.array([new] + [0] * (len(sizes) - 1), pa.int64())], names=["chunk", "kind", "bucket", "n", "counts", "new"])

    return parts.groupBy("kind", "bucket").applyInArrow(run, "chunk long, kind int, bucket int, n int, counts binary, new long")


def losses(n: np.ndarray, word: np.ndarray, context: np.ndarray, total: float, by: float, size: int, prior: float = PRIOR) -> np.ndarray:
    """-log P(b | a) of bigrams, smoothed towards the unigram model, in units; counts are scaled by `by`."""
    unigram = (word * by + 1.0) / (total * by + size)
    return np.floor(-np.log((n * by + prior * unigram) / (context * by + prior)) / UNIT + 0.5).astype(np.int64)


def document_losses(table: DataFrame, counts: DataFrame, t: int, o: int, size: int) -> DataFrame:
    """(doc_id, n, lt, lb): tokens of each document and the sums of their losses in both models."""
    scale = t / o if t and o else 1.0  # of the background to the target's mass

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        sizes = np.array(row["sizes"], np.int64)
        x = Bigrams(sizes, *(row[c] for c in _CHUNK[1:]))
        parts = sorted(given.to_pylist(), key=lambda r: r["bucket"])
        pairs, words = (np.concatenate([np.zeros((k, 0), np.int64), *(unpack(r["counts"], np.int64, r["n"] * k).reshape(k, r["n"]) for r in parts if r["kind"] == k)], axis=1)
                        for k in (BIGRAM, WORD))
        by_place = np.empty_like(words)
        by_place[:, x.order] = words
        wt, wo, ct, co = by_place
        sums = []
        for of in (losses(pairs[0], wt[x.b], ct[x.a], t, 1.0, size), losses(pairs[1], wo[x.b], co[x.a], o, scale, size)):
            each = np.zeros(row["n"] + 1, np.int64)
            each[x.at + 1] = of[x.of]
            upto = np.cumsum(each)
            sums.append(upto[x.ends] - upto[x.ends - sizes])
        return pa.table([pa.array(row["ids"], pa.int64()), sizes - 1, *sums], names=["doc_id", "n", "lt", "lb"])

    own = table.select("chunk", "ids", *_CHUNK)
    return own.groupBy("chunk").cogroup(counts.drop("new").groupBy("chunk")).applyInArrow(run, "doc_id long, n long, lt long, lb long")


def scores(docs: DataFrame, labels: DataFrame, n_words: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), losses and their difference a token."""
    words = None if n_words is None else vocabulary(docs, n_words)
    own = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    good = materialize(good_documents(labels).where("target"), "op9-good")
    flagged = own.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    with short_batches(docs.sparkSession):
        table = materialize(chunks(flagged, words), "op9-chunks")
    t, o = table.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    counts = materialize(totals(shares(table, max(4, ((t + o) // BUCKET).bit_length()))), "op9-totals")
    distinct = counts.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0] if words is None else len(words)
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n") * UNIT).otherwise(0.0)
    return document_losses(table, counts, t, o, distinct + 2).select(
        "doc_id", F.col("n").alias("n_tokens"), mean("lt").alias("target_loss"), mean("lb").alias("background_loss"),
        (mean("lb") - mean("lt")).alias("score"))
