"""Scored layer by segment, bucketed layers, lookups of ids, model evaluated once, streams that run again."""

import os
import uuid

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lapse.operators import profile as PR
from lapse.operators import scorecard as SC
from lapse.operators import scoring as S
from lapse.operators import segments as SG
from lapse.plans import known_models as KM
from lapse.plans import layers as L
from lapse.session import bucketed, ensure_checkpoint_dir
from lapse.sources import files as IO
from lapse.streaming import scoring as ST


def folder(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def files_of(path):
    path = path.removeprefix("file:")
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


# ---------------------------------------------------------------- scored layer by segment
@pytest.fixture()
def scored_path(spark):
    path = folder(spark, "scored")
    IO.write_scored(L.scored(spark, SF_SMALL).select("customerID", "churn_probability", "segment_label"), path)
    return path


def test_a_report_of_one_segment_reads_its_folder(spark, scored_path):
    one = spark.read.parquet(scored_path).where("segment_label = 'Monitor Only'")
    assert rows_of(one) == rows_of(L.scored(spark, SF_SMALL).where("segment_label = 'Monitor Only'").select("customerID", "churn_probability", "segment_label"))
    plan = L.scored_by_segment(spark, SF_SMALL).where("segment_label = 'Save Immediately'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment_label" in plan
    assert all("Monitor" in r[0] for r in one.select(F.input_file_name()).distinct().collect())


def test_rescoring_a_segment_rewrites_that_one_only(spark, scored_path):
    before, was = files_of(scored_path), spark.read.parquet(scored_path).collect()
    new = spark.read.parquet(scored_path).where("segment_label = 'Monitor Only'").withColumn("churn_probability", F.lit(0.125))
    assert IO.update_scored(spark, scored_path, new) == ["Monitor Only"]
    after = files_of(scored_path)
    changed = {f.split("/")[0] for f in before ^ after}
    assert len(changed) == 1 and "Monitor" in changed.pop()
    got = {r["customerID"]: (r["churn_probability"], r["segment_label"]) for r in spark.read.parquet(scored_path).collect()}
    assert got == {r["customerID"]: (0.125 if r["segment_label"] == "Monitor Only" else r["churn_probability"], r["segment_label"]) for r in was}


def test_customers_that_change_segment_move(spark, scored_path):
    was = {r["customerID"]: (r["churn_probability"], r["segment_label"]) for r in spark.read.parquet(scored_path).collect()}
    moved = spark.read.parquet(scored_path).where("segment_label = 'Assess & Offer'").withColumn("segment_label", F.lit("Save Immediately"))
    moved = moved.unionByName(spark.createDataFrame([("new one", 0.5, "Save Immediately")], moved.schema))
    assert IO.update_scored(spark, scored_path, moved) == ["Assess & Offer", "Save Immediately"]
    got = {r["customerID"]: (r["churn_probability"], r["segment_label"]) for r in spark.read.parquet(scored_path).collect()}
    assert got == {c: (p, "Save Immediately" if s == "Assess & Offer" else s) for c, (p, s) in was.items()} | {"new one": (0.5, "Save Immediately")}


# ---------------------------------------------------------------- the model is evaluated once a row
def test_ranking_reads_written_scores(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        """A model that counts the rows that it scores."""
        stages = SC.pipeline(spark, KM.LOGISTIC).stages

        def transform(self, df):
            @F.pandas_udf("string")
            def through(c):
                seen.add(len(c))
                return c
            return SC.pipeline(spark, KM.LOGISTIC).transform(df.withColumn("customerID", through("customerID")))

    feats = L.features(spark, SF_SMALL)
    out = S.risk_rank(S.score_once(Counting(), feats, 0.5, "logistic", median_charge=60.0))
    assert out.count() == 150 and out.select("risk_rank").distinct().count() == 150
    assert seen.value == 150


# ---------------------------------------------------------------- streams
def arrivals(spark, parts=3):
    raw = L.raw(spark, SF_SMALL).drop("Churn")
    first = raw.agg(F.min("customerID")).first()[0]
    src = folder(spark, "arrivals")
    raw.withColumn("tenure", F.when(F.col("customerID") != first, F.col("tenure"))).repartition(parts).write.parquet(src)
    return src, first


def test_stream_lists_rejects_and_survives_a_restart(spark):
    src, first = arrivals(spark)
    model, cols = SC.pipeline(spark, KM.LOGISTIC), list(KM.FEATURES)
    scored, rejects, state, reports = folder(spark, "scored"), folder(spark, "rejects"), folder(spark, "state"), {}

    def run(report):
        q = ST.start_scoring_with_rejects(spark, src, scored, rejects, state, model, 0.5, 60.0, cols, max_files_per_trigger=1, report=report)
        q.awaitTermination()

    def breaks(batch_id, counts):
        reports[batch_id] = counts
        if batch_id == 1:
            raise RuntimeError("stopped after the second batch was written, before it was committed")

    with pytest.raises(Exception, match="stopped after"):
        run(breaks)
    assert set(reports) == {0, 1}
    run(reports.__setitem__)
    assert sum(r["rows"] for r in reports.values()) == 150 and sum(r["rejected"] for r in reports.values()) == 1
    got = spark.read.parquet(scored)
    assert got.count() == got.select("customerID").distinct().count() == 149
    assert [(r["customerID"], r["missing"]) for r in spark.read.parquet(rejects).collect()] == [(first, ["tenure"])]


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark):
    src, _ = arrivals(spark)
    scored, rejects = folder(spark, "scored"), folder(spark, "rejects")
    work = ST.two_sinks(scored, rejects, SC.pipeline(spark, KM.LOGISTIC), 0.5, 60.0, list(KM.FEATURES))
    for _ in range(2):
        work(spark.read.schema(ST.arrivals_schema()).parquet(src), 7)
    assert spark.read.parquet(scored).count() == 149 and spark.read.parquet(rejects).count() == 1


# ---------------------------------------------------------------- bucketed layers, lookups
def test_joins_of_layers_on_the_id_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feats, split, scored, cleaned = (f(spark, SF_SMALL) for f in (L.features, L.split, L.scored, L.cleaned))
        for a, b in ((feats, split.where("split = 'test'").select("customerID")), (cleaned, scored.select("customerID", "risk_rank")),
                     (feats, split.select("customerID", "split", "class_pos"))):
            joined = a.join(b, "customerID")
            assert joined.count() == b.count()
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scanned(df):
    """Rows that the scan read, before its filter."""
    plan = df._jdf.queryExecution().executedPlan()
    found = len(df.collect())
    df._jdf.collectToPython()
    return found, plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_a_lookup_of_ids_reads_few_buckets_and_row_groups(spark):
    rows = spark.range(200_000).select(F.format_string("id%09d", F.col("id") * 2).alias("customerID"), F.col("id").alias("v"))
    table = bucketed(rows, "lookup", "customerID", buckets=16, row_group_bytes=32 * 1024)
    assert table.count() == 200_000
    ids = [f"id{2 * i:09d}" for i in range(0, 200_000, 20_000)]
    found, read = scanned(PR.lookup(table, ids))
    assert found == 10 and 0 < read < 10 * 200_000 / 16 / 2  # not even half of each id's bucket
    # Inside the range of a row group, but not in its bloom filter.
    found, read = scanned(PR.lookup(table, ["id000000011", "id000300001"]))
    assert found == 0 and read == 0


def test_profiles_of_named_customers(spark):
    ids = [r[0] for r in L.cleaned(spark, SF_SMALL).select("customerID").orderBy("customerID").limit(3).collect()]
    got = PR.customer_profile(PR.lookup(L.display(spark, SF_SMALL), ids))
    want = PR.customer_profile(L.display(spark, SF_SMALL)).where(F.col("customerID").isin(ids))
    assert rows_of(got) == rows_of(want) and got.count() > 60
    # both sides of the join are cut by the ids
    assert got._jdf.queryExecution().optimizedPlan().toString().count(" IN (Customer#") == 2
