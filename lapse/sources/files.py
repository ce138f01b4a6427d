"""Sources and sinks: raw CSV/Parquet scans with an explicit schema, layer
tables, model results, importance tables, model persistence and exports.

All writes are distributed (one file per task); exports are range-sorted so
the part files read back in order without funnelling rows through one task.
Scratch locations live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lapse.config import ID_COL, MODEL_KEYS, RAW_SCHEMA, REQUIRED_RAW_COLS
from lapse.session import drop_tables, ensure_checkpoint_dir, materialize, table_exists


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def load_raw(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw subscriber table with the fixed schema (never inferred)."""
    if fmt == "csv":
        return spark.read.schema(RAW_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def validate(df: DataFrame) -> DataFrame:
    """Fail clearly when a required column is missing."""
    missing = REQUIRED_RAW_COLS - set(df.columns)
    if missing:
        raise ValueError(f"missing expected columns: {sorted(missing)}")
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header; whitespace is kept as is (a blank TotalCharges stays blank)."""
    (df.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_layer(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Parquet layer table (cleaned / features / scored)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def counted(df: DataFrame, *conditions: tuple[str, Column]) -> tuple[DataFrame, Observation]:
    """`df` as it is, and its number of rows (`rows`) and of those that meet each named condition, counted by whatever action
    runs it; `Observation.get` has them afterwards."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions]), seen


def write_scored(df: DataFrame, path: str) -> str:
    """The scored layer by segment, one folder each: a reader of one segment reads its folder alone."""
    return write_layer(df, path, partition_by=["segment_label"])


def update_scored(spark: SparkSession, path: str, rescored: DataFrame) -> list[str]:
    """Replace customers of a scored layer by newly scored rows; returns the segments that were rewritten.

    Only segments that a customer leaves or enters are read in full and rewritten, each at once (dynamic partition
    overwrite); all others stay as they are. `rescored` has the layer's columns; a customer that the layer doesn't hold is new."""
    new = materialize(rescored, "rescored")
    layer = spark.read.parquet(path)
    left = layer.select(ID_COL, "segment_label").join(new.select(ID_COL), ID_COL, "left_semi").select("segment_label")
    touched = sorted(r[0] for r in left.unionByName(new.select("segment_label")).distinct().collect())  # of the segment dimension
    stay = layer.where(F.col("segment_label").isin(touched)).join(new.select(ID_COL), ID_COL, "left_anti")
    # Written aside first: a folder can't be read and replaced in one job.
    whole = materialize(stay.select(*layer.columns).unionByName(new.select(*layer.columns)), "rescored-segments")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_label").parquet(path)
    kept = {r[0] for r in whole.select("segment_label").distinct().collect()}
    # A segment that all its customers left has no rows that could replace it.
    empty = [f"{path}/segment_label={s.replace(' ', '%20')}" for s in touched if s not in kept]
    drop_tables(spark, [p if table_exists(spark, p) else p.replace("%20", " ") for p in empty])
    return touched


def read_layer(spark: SparkSession, path: str, produced_by: str = "the previous step") -> DataFrame:
    """Read a layer, failing with a clear message when it has not been produced yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise FileNotFoundError(f"{path} not found: run {produced_by} first")
    return spark.read.parquet(path)


def write_model_results(results: DataFrame, path: str) -> str:
    """One JSON record per model (distributed write)."""
    results.write.mode("overwrite").json(path)
    return path


def read_model_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "model string, cv_auc_mean double, cv_auc_std double, val_f1 double, threshold double, test_auc double, "
        "test_precision double, test_recall double, test_f1 double").json(path)


def write_importance(blocks: list[DataFrame], path: str) -> str:
    """Append the importance blocks (feature, importance, model) into one table."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance double, model string").option("header", True).csv(path)


def save_models(models: dict, root: str) -> dict[str, str]:
    """Persist fitted PipelineModels (Spark ML format) under root/<name>."""
    paths = {}
    for name, model in models.items():
        p = os.path.join(root, name)
        model.write().overwrite().save(p)
        paths[name] = p
    return paths


def load_models(spark: SparkSession, root: str, names: list[str] | None = None) -> dict:
    """Load only the models that are present under root."""
    from pyspark.ml import PipelineModel
    out = {}
    jvm = spark._jvm
    fs_conf = spark._jsc.hadoopConfiguration()
    for name in names or MODEL_KEYS:
        p = os.path.join(root, name)
        jp = jvm.org.apache.hadoop.fs.Path(p)
        if jp.getFileSystem(fs_conf).exists(jp):
            out[name] = PipelineModel.load(p)
    return out


def export_sorted(df: DataFrame, path: str, order: list, header: bool = True) -> str:
    """Sorted CSV export: a global sort (range partitioning) so part files are in order."""
    df.orderBy(*order).write.mode("overwrite").option("header", header).csv(path)
    return path


def export_segment(scored: DataFrame, label: str, path: str) -> str:
    """One segment's rows, highest revenue at risk first; of a layer written by segment, one folder is read."""
    seg = scored.where(F.col("segment_label") == label)
    return export_sorted(seg, path, [F.col("revenue_at_risk").desc(), F.col("customerID")])


def export_targets(targets: DataFrame, path: str) -> str:
    """The targeted list of an allocation, in ROI order."""
    return export_sorted(targets, path, [F.col("roi_rank")])
