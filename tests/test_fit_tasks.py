"""Tasks of fits and of scoring: few where rows are few, a core's each at most, and one model each."""

import uuid

from conftest import SF_SMALL
from pyspark.sql import functions as F

from lapse.operators import features as FE
from lapse.operators import train as T
from lapse.plans import layers as L
from lapse.session import intermediate_scope, materialize_parts, shared_folder


def fits(spark):
    feats = L.features(spark, SF_SMALL)
    return T.Fits(feats, L.split(spark, SF_SMALL), FE.model_columns(feats), T.Profile(rf_trees=3, gbt_rounds=2, lr_max_iter=10, cv_folds=3))


def test_a_small_fold_or_split_is_scored_by_one_task(spark):
    f = fits(spark)
    assert f.data.rdd.getNumPartitions() > 1
    assert all(df.rdd.getNumPartitions() == 1 for df in (f.fold(0), f.split("val"), f.split("test"), f.split("none")))
    assert f.fold(1).count() == sum(n for (k, _), n in f.sizes.items() if k == 1)
    assert f.split("test").count() == f.split_rows["test"] == f.data.where("split = 'test'").count()


def test_a_fit_has_a_task_a_core_at_most(spark, monkeypatch):
    f = fits(spark)
    monkeypatch.setattr(T, "ROWS_PER_TASK", 1)
    cores = spark.sparkContext.defaultParallelism
    f.train = f.train.repartition(3 * cores)
    assert f.rows(None).rdd.getNumPartitions() == cores
    assert f.rows(None).count() == sum(f.sizes.values())


def test_parts_are_written_by_jobs_of_their_own_and_read_as_one(spark):
    parts = [spark.range(10 * k).select(F.lit(f"m{k}").alias("model"), F.col("id").alias("p")) for k in range(4)]
    with intermediate_scope() as paths:
        out = materialize_parts(parts, "parts")
    assert {r["model"]: r["count"] for r in out.groupBy("model").count().collect()} == {"m1": 10, "m2": 20, "m3": 30}
    assert len(paths) == 1 and {x.split(paths[0].rsplit("/", 1)[1])[1][1] for x in out.inputFiles()} <= set("0123")
    assert out.columns == ["model", "p"]


def test_a_task_of_a_fit_carries_no_files_of_the_training_table(spark, monkeypatch):
    f = fits(spark)
    f._data_print += uuid.uuid4().hex  # no earlier run's fits
    path = f"{shared_folder(spark)}/many-{uuid.uuid4().hex}"
    f.train.repartition(40).write.parquet(path)
    f.train = spark.read.parquet(path)
    given, fit = [], T.Pipeline.fit
    monkeypatch.setattr(T.Pipeline, "fit", lambda self, df: given.append(df) or fit(self, df))
    f.models(["gbt", "logistic"], [1])
    sizes = [len(spark._jvm.org.apache.spark.util.Utils.serialize(p)) for df in given for p in df._jdf.rdd().partitions()]
    assert len(sizes) == 2 and max(sizes) < 500  # one task a fit, however many files
    assert len(set(map(id, given))) == 1  # the models of a fold read one checkpoint
    own = f.rows(1).select(*given[0].columns)
    assert [str(r) for r in given[0].collect()] == [str(r) for r in own.collect()]
