"""Distributed ranks against plain sorting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import ranks


@pytest.fixture(autouse=True)
def many_parts(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def rows(n=2000):
    rng = random.Random(n)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(7)] + [3] * 9), rng.choice([None, "x", "y"]), k) for k in range(n)]


def frame(spark, some):
    return spark.createDataFrame(some, "g string, v int, part string, id int").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_equal_row_numbers(spark, descending):
    """A rank for each number, in the order of keys with ties and nulls, over all rows."""
    some = rows()
    v = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    got = sorted((r["rank"], r["v"], r["all_of"]) for r in ranks.ranked(frame(spark, some), v, total="all_of").collect())
    assert [r[0] for r in got] == list(range(1, len(some) + 1)) and {r[2] for r in got} == {len(some)}
    key = (lambda x: (x is None, -(x or 0))) if descending else (lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == sorted((r[1] for r in some), key=key)


def test_ranks_within_groups_and_clashing_names(spark):
    some = rows(900)
    got = ranks.ranked(frame(spark, some).withColumn("rank", F.lit("old")).withColumn("n", F.lit(1)), F.col("id"), within=("g",)).collect()
    by = defaultdict(list)
    for g, _, _, i in some:
        by[g].append(i)
    assert {(r["g"], r["id"], r["rank"]) for r in got} == {(g, i, k + 1) for g, ids in by.items() for k, i in enumerate(sorted(ids))}
    assert {r["n"] for r in got} == {1} and len(got) == len(some)


def test_batches_drop_what_fills_none(spark):
    some = rows(103)
    got = ranks.batched(frame(spark, some), 8, F.col("id")).collect()
    assert sorted((r["batch"], r["id"]) for r in got) == [(i // 8, i) for i in range(96)]
    got = ranks.batched(frame(spark, some), 8, F.col("id"), within=("g",)).groupBy("g", "batch").count().collect()
    assert {r["count"] for r in got} == {8}


def test_no_rows_and_no_single_task(spark):
    assert ranks.ranked(frame(spark, []), F.col("v")).collect() == []
    plan = ranks.ranked(frame(spark, rows(50)), F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_hot_tie_is_spread(spark):
    """Rows of one sort key are dealt to several partitions."""
    some = [("g", 1, None, k) for k in range(5000)]
    got = ranks.ranked(frame(spark, some), F.col("v"), within=("g",), rank="r").withColumn("task", F.spark_partition_id())
    assert sorted(r["r"] for r in got.collect()) == list(range(1, 5001))
