"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes all that its predecessor kept and returns the columns of
`documents`, the last one digests of each document's ids. Stages are written as
Parquet to the shared folder and read again, so that a lost executor never
repeats an earlier one; a stage's own tables go when its output is written.

Null texts have no language and go in the first stage. A document that line
dedup empties stays, with an empty text. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapse.llm import bpe, decontam, langid, line_dedup, near_dedup
from lapse.llm.common import read, short_batches
from lapse.llm.queries import tokenizer_path
from lapse.session import drop_tables, intermediate_scope, materialize


#: Most entries of one generation of a worker's memo in the last stage.
ENCODING_MEMO = 80_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a known language go. Profiles are learned from the labelled rows."""
    return langid.identified(docs, langid.training_rows(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: later copies of runs of lines of 50 words or more are deleted from the texts."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group stays, over shingles of five words and a similarity of 0.8."""
    return near_dedup.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids and the text decoded from them, as digests, written while batches are short; its workers
    remember less than operator 10's alone, since an executor still holds the memory of the stages before."""
    with short_batches(spark):
        return materialize(bpe.digests(bpe.round_trip(docs, tokenizer_path(), memo=ENCODING_MEMO)), "stage-bpe")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language id", language),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("bpe", encoding),
]

#: Language profiles and merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with intermediate_scope() as written, short_batches(spark):
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        # The stage's table is written last; nothing reads its own tables, or the stage before it, any more.
        *inner, own = written
        drop_tables(spark, [*inner, *before])
        before = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
