"""Structured Streaming scorer for new arrivals.

Arrivals land as files (raw 21-column shape, label optional) in a source
folder; the query reads them with the fixed schema, applies the stateless
`score_arrivals` projection (frozen training median, threshold, feature list,
fitted model, 4-row segment dimension broadcast) and appends to a Parquet
sink. The checkpoint location makes the sink exactly-once across restarts and
executor loss; `availableNow` processes the backlog and stops.

`start_scoring_with_rejects` writes two tables a batch, the scored arrivals and
those that lack a model input. Both go to folders named by the batch's id, so a
batch that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lapse.config import RAW_SCHEMA
from lapse.operators.scoring import rejected
from lapse.operators.serving import ARRIVAL_INPUTS, score_arrivals
from lapse.sources.files import counted


def arrivals_schema(with_label: bool = False) -> T.StructType:
    fields = [f for f in RAW_SCHEMA.fields if with_label or f.name != "Churn"]
    return T.StructType(fields)


def read_arrivals(spark: SparkSession, source_dir: str, fmt: str = "parquet", with_label: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(arrivals_schema(with_label)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir)


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, model, threshold: float,
                  high_value_cut: float, feature_cols: list[str], model_name: str = "model", fmt: str = "parquet",
                  available_now: bool = True, processing_time: str | None = None):
    """Start the scoring stream; returns the StreamingQuery."""
    stream = read_arrivals(spark, source_dir, fmt)
    scored = score_arrivals(stream, model, threshold, high_value_cut, feature_cols, model_name)
    writer = (scored.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def score_backlog(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, model, threshold: float,
                  high_value_cut: float, feature_cols: list[str], model_name: str = "model",
                  fmt: str = "parquet") -> DataFrame:
    """Process every file present in the source folder, then return the sink as a batch DataFrame."""
    q = start_scoring(spark, source_dir, sink_dir, checkpoint_dir, model, threshold, high_value_cut, feature_cols,
                      model_name, fmt, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink_dir)


def two_sinks(scored_dir: str, rejects_dir: str, model, threshold: float, high_value_cut: float, feature_cols: list[str],
              model_name: str = "model", report: Callable[[int, dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The work of one batch: scored arrivals and rejected ones, each to the folder `batch=<id>` of its table.

    A repeated batch overwrites its folders, so nothing is lost or doubled. `report` gets the rows in, scored and rejected,
    counted by the writes themselves."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by both sinks; a micro-batch
        try:
            scored, n_scored = counted(score_arrivals(batch, model, threshold, high_value_cut, feature_cols, model_name))
            left_out, n_rejected = counted(rejected(batch, ARRIVAL_INPUTS))
            scored.write.mode("overwrite").parquet(f"{scored_dir}/batch={batch_id}")
            left_out.write.mode("overwrite").parquet(f"{rejects_dir}/batch={batch_id}")
            if report:
                a, b = n_scored.get["rows"], n_rejected.get["rows"]
                report(batch_id, {"rows": a + b, "scored": a, "rejected": b})
        finally:
            batch.unpersist()

    return write


def start_scoring_with_rejects(spark: SparkSession, source_dir: str, scored_dir: str, rejects_dir: str, checkpoint_dir: str,
                               model, threshold: float, high_value_cut: float, feature_cols: list[str],
                               model_name: str = "model", fmt: str = "parquet", max_files_per_trigger: int | None = None,
                               report: Callable[[int, dict], None] | None = None):
    """Start scoring with both sinks over the files that wait; returns the StreamingQuery."""
    work = two_sinks(scored_dir, rejects_dir, model, threshold, high_value_cut, feature_cols, model_name, report)
    arrivals = read_arrivals(spark, source_dir, fmt, max_files_per_trigger=max_files_per_trigger)
    return (arrivals.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
