"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "lapse", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster, use the cluster's own session."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LAPSE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is
    only chosen when nothing is configured (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):  # local-cluster has machines of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="lapse-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_folder(spark: SparkSession) -> str:
    """The configured shared folder, the same for every session that names it; the session's own where none is named."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or ensure_checkpoint_dir(spark))


def _file_system(spark: SparkSession, path: str):
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()), jp


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, jp = _file_system(spark, path)
    return bool(fs.exists(jp))


def rename_table(spark: SparkSession, path: str, to: str) -> None:
    """Give a written table its name in one step; if another run was first, its table stays and ours goes."""
    fs, jp = _file_system(spark, path)
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(to)) or not fs.rename(jp, spark._jvm.org.apache.hadoop.fs.Path(to)):
        fs.delete(jp, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint (the table survives executor loss) but
    keeps a columnar source, so later scans prune columns and push filters.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    scope = getattr(_SCOPE, "paths", None)
    if scope is not None:
        scope.append(path)
    return spark.read.parquet(path)


def materialize_parts(parts: list[DataFrame], name: str, parallelism: int = 8) -> DataFrame:
    """The union of `parts`, which have one schema, written by one job each, run concurrently from driver threads.

    A task of a union's job carries the plan of every part; here it carries its own part's alone, and with it one model
    where each part is scored by its own."""
    spark = parts[0].sparkSession
    root = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    paths = [f"{root}/{i}" for i in range(len(parts))]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        list(pool.map(lambda x: x[0].write.mode("overwrite").parquet(x[1]), zip(parts, paths, strict=True)))
    scope = getattr(_SCOPE, "paths", None)
    if scope is not None:
        scope.append(root)
    return spark.read.schema(parts[0].schema).parquet(*paths)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """Write `df` as a catalog table in the shared folder, bucketed and sorted by `key`, and read it.

    Tables of one key and number of buckets (by default the session's shuffle partitions) are joined on it without an
    exchange; a lookup of keys reads their buckets alone, and in them, by sorted ranges and bloom filters, few row groups."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lapse_{re.sub('[^a-z0-9]', '_', name.lower())}_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), table)
    writer = (df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
              .option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true"))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.saveAsTable(table)
    scope = getattr(_SCOPE, "paths", None)
    if scope is not None:
        scope.append(path)
    return spark.table(table)


_SCOPE = threading.local()


@contextlib.contextmanager
def intermediate_scope():
    """Collect the paths of the tables `materialize` writes on this thread inside the block."""
    outer = getattr(_SCOPE, "paths", None)
    _SCOPE.paths = []
    try:
        yield _SCOPE.paths
    finally:
        inner = _SCOPE.paths
        _SCOPE.paths = outer
        if outer is not None:
            outer.extend(inner)


def drop_tables(spark: SparkSession, paths: list[str]) -> int:
    """Delete intermediate tables from the shared folder once nothing reads them; returns the count."""
    conf = spark._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        jp = spark._jvm.org.apache.hadoop.fs.Path(p)
        n += int(bool(jp.getFileSystem(conf).delete(jp, True)))
    return n
