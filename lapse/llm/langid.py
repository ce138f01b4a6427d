"""Operator 5: language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (one to three,
words padded with a space) in rank order, counted over all labelled training
texts. A document is compared by the out-of-place distance: for each of its own
most frequent n-grams, how many ranks it stands away from its place in the
profile, an n-gram that the profile lacks counting as the profile's length.
The nearest profile names the language. The filter of the pipeline also rejects
texts that lie further from it than texts of that language and about that length
do: a bound is learned from all training rows. A language of too few training
rows for any length has no bound.

Null text, or one without a letter: `und` with score 0. Empty training set:
`und` for all. Ties in rank go to the smaller n-gram, ties in distance to the
smaller language name. Repeated rows each have their own row; an empty table
gives an empty result. A null lang is not learned from; a null doc_id counts as
an empty string for the fold. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, rows_of

#: N-grams in a profile, and most n-grams compared of a document.
PROFILE = 400
UNKNOWN = "und"
#: Code units that a counting task gathers of a language before it counts them.
GATHERED = 1 << 18

#: A bound is the score that all but this share of a language's training rows of one length reach, less a margin.
LOWEST, MARGIN = 0.001, 0.05
#: Fewest training rows of a length from which a bound is learned; lengths are doubling classes of code points.
FEWEST = 20

WORDS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold that training leaves out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def letters(text: str | None) -> np.ndarray | None:
    """Code points of the lower-case words, each between spaces; None without a letter."""
    found = " ".join(WORDS.findall(text)) if text else ""
    if not any(c.isalpha() for c in found):
        return None
    return np.frombuffer(f" {found.lower()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def grams(points: np.ndarray) -> np.ndarray:
    """All one- to three-grams as numbers (21 bits a character); those of spaces alone don't count."""
    one, shift = points, np.uint64(21)
    two = one[:-1] << shift | one[1:]
    three = two[:-1] << shift | one[2:]
    return np.concatenate([one[one != 32], two, three])


def ranked(codes: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The `n` most frequent codes, most frequent first."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:n]]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, code, n) over whole texts of (text, lang). A task holds one bounded buffer a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def counted(lang: str) -> Iterator[tuple]:
            found, counts = np.unique(np.concatenate([grams(x) for x in held.pop(lang)]), return_counts=True)
            size[lang] = 0
            for code, n in zip(found.tolist(), counts.tolist(), strict=True):
                yield lang, code, n

        def rows() -> Iterator[tuple]:
            for text, lang in rows_of(batches, "text", "lang"):
                if (points := letters(text)) is not None:
                    held.setdefault(lang, []).append(points)
                    size[lang] = size.get(lang, 0) + len(points)
                    if size[lang] >= GATHERED:
                        yield from counted(lang)
            for lang in list(held):
                yield from counted(lang)

        yield from batches_of(rows(), pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())]), 20_000)

    parts = labelled.select("text", "lang").mapInArrow(count, "lang string, code long, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, n: int = PROFILE) -> DataFrame:
    """(lang, code, place): the `n` most frequent n-grams of each language, place 0 the most frequent."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return gram_counts(labelled).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n).select("lang", "code", "place")


class Profiles:
    """Profiles as one matrix: place of each known code in each language, `n` where it has none."""

    def __init__(self, rows: list[tuple[str, int, int]], n: int = PROFILE) -> None:
        self.n, self.langs = n, sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), dtype=np.uint64)
        self.places = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, code, place in rows:
            self.places[np.searchsorted(self.codes, np.uint64(code)), self.langs.index(lang)] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and 1 less its distance as a share of the largest possible."""
        return self.judged(text)[:2]

    def judged(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and the class of its length."""
        points = letters(text)
        if points is None or not self.langs:
            return UNKNOWN, 0.0, 0
        own = ranked(grams(points), self.n)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        places = self.places[at]
        away = np.where(places < 0, self.n, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.n * len(own)), len(points).bit_length()


def learned(training: DataFrame, n: int = PROFILE) -> Broadcast:
    """Profiles of the languages of rows (text, lang). The driver takes `n` rows for each language."""
    return training.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles(training, n).collect()], n))


def predict(docs: DataFrame, training: DataFrame, n: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs`, by profiles learned from rows (text, lang)."""
    shared = learned(training, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        rows = ((i, out, *known.predict(text)) for i, out, text in rows_of(batches, "doc_id", "held_out", "text"))
        yield from batches_of(rows, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]), 2_000)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def bounds(training: DataFrame, shared: Broadcast) -> dict[str, dict[int, float]]:
    """Least score by language and length class, from the training rows that are told as what they are labelled. The
    driver takes one row a language and class; scores are counted in thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((lang, *shared.value.judged(text)) for text, lang in rows_of(batches, "text", "lang"))
        yield from batches_of(((lang, size, round(score, 3)) for lang, told, score, size in rows if told == lang), pa.schema([
            ("lang", pa.string()), ("size", pa.int32()), ("score", pa.float64())]), 2_000)

    scored = training.select("text", "lang").mapInArrow(run, "lang string, size int, score double")
    found = scored.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.percentile("score", F.lit(LOWEST)).alias("least")).where(F.col("n") >= FEWEST)
    out: dict[str, dict[int, float]] = {}
    for r in found.collect():
        out.setdefault(r["lang"], {})[r["size"]] = r["least"] - MARGIN
    return out


def least(of: dict[str, dict[int, float]], lang: str, size: int) -> float:
    """Bound of a text: that of the nearest class not longer than its own, for shorter ones the language's lowest."""
    own = of.get(lang, {})
    shorter = [k for k in own if k <= size]
    return own[max(shorter)] if shorter else min(own.values(), default=0.0)


def identified(docs: DataFrame, training: DataFrame, n: int = PROFILE) -> DataFrame:
    """`docs` without the rows whose language is unknown: without a letter, or too far from the nearest profile."""
    shared = learned(training, n)
    bound = docs.sparkSession.sparkContext.broadcast(bounds(training, shared))

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))  # so that long texts don't pile up
        return pa.array([lang != UNKNOWN and score >= least(bound.value, lang, size)
                         for part in parts for lang, score, size in map(shared.value.judged, part)], pa.bool_())

    return docs.where(known(docs["text"]))


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of the rows that may be learned from."""
    return docs.where(docs["lang"].isNotNull() & ~held_out(docs["doc_id"])).select(docs["text"], docs["lang"])
