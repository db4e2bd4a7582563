"""Plan shapes that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feedloom.operators import lifecycle as li
from feedloom.operators import listing as ls
from feedloom.operators import mutate as mu
from feedloom.plans.corpus import Corpus
from feedloom.sources import store

FOLDER = "/root/testdata/sf0.001"
RUN_FIRST = {"queue_stream", "lifecycle_stream", "approved_stream", "scheduled_collect"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - RUN_FIRST))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan
    # Only one-row results may meet in one partition, and only after partial aggregation or a top-k.
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:
            after = plan.splitlines()[plan.splitlines().index(line) + 1]
            assert "Aggregate" in after or "LocalLimit" in after or "TakeOrdered" in after, after


def test_listing_reads_narrow_columns_only(spark):
    plan = plan_of(entry.queries()["articles_by_status"](spark, FOLDER))
    assert "text" not in "".join(re.findall(r"ReadSchema: \S+", plan))


def test_snapshot_scan_by_status_prunes_partitions(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string"), F.concat(F.lit("S"), F.col("id") % 4).alias("status"),
                                   F.current_timestamp().alias("created_at"))
    store.write_snapshot(rows, str(tmp_path / "t"), 1, partition_by="status")
    plan = plan_of(ls.filter_articles(store.read_snapshot(spark, str(tmp_path / "t"), 1), status="S1"))
    assert re.search(r"PartitionFilters: \[.*status", plan)


def test_page_details_do_not_sort_wide_rows(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("string"), F.lit("x").alias("body")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    page = table.orderBy("id").limit(3)
    details = ls.page_details(page, table)
    assert details.count() == 3
    plan = final_plan(details)
    assert "BroadcastHashJoin" in plan and "body" not in "".join(x for x in plan.splitlines() if "Sort" in x)


def test_replay_reads_the_log_once(spark):
    corpus = Corpus(spark, FOLDER)
    log = r"FileScan parquet \[event_id#\d+L,ts#\d+,user_id"
    read = final_plan(li.command_functions(corpus.commands))
    assert len(re.findall(log, read)) == 1 and read.count("rangepartitioning") == 1
    # What is left works on the functions that this one reading wrote.
    assert not re.findall(log, final_plan(li.replay(corpus.articles, corpus.commands)))


def test_small_batches_do_not_move_the_table(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string"), F.lit("s").alias("slug"), F.current_timestamp().alias("updated_at")
                             ).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    patch = ids.select(F.lit(1).alias("seq"), "id", F.array(F.lit("slug")).alias("fields"), F.lit("new").alias("slug"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (mu.delete_rows(table, ids, "id"), mu.patch_articles(table, patch, F.current_timestamp())):
            lines = final_plan(out).splitlines()
            scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
            depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*"))
            above = [x for x in lines[:scan] if len(x) - len(x.lstrip(" :+-*")) < depth]
            join = max(i for i, x in enumerate(above) if "BroadcastHashJoin" in x)
            assert not any("Exchange" in x for x in above[join:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
