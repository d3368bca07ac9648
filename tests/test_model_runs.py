"""Observed writes, rewards that are asked for once, and a chain that goes on after a kill."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import chain, observed, rewards


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(10_000).withColumn("v", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3))
    sc = spark.sparkContext
    sc.setJobGroup("observed", "one write")
    told = observed.write_kept(df, F.col("v") == 0, str(tmp_path / "out"))
    jobs = sc.statusTracker().getJobIdsForGroup("observed")
    sc.setLocalProperty("spark.jobGroup.id", None)
    kept = df.where("v = 0").count()
    assert (told.n_kept, told.n_skipped) == (kept, 10_000 - kept) and len(jobs) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == kept
    assert told.seconds > 0 and told.rows_per_minute == pytest.approx(kept / told.seconds * 60)


def test_rewards_are_asked_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def score(texts):
        asked.add(len(texts))
        return [None if b is None else len(a or "") - len(b) / 2 for a, b in texts]

    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "bb", None, "a\x00b"]), rng.choice(["", "x", None, "yyy"])) for k in range(200)]
    df = spark.createDataFrame(rows, "reward_key int, prompt string, completion string")
    table = rewards.RewardTable(spark, str(tmp_path / "rewards"))
    want = {k: None if b is None else len(a or "") - len(b) / 2 for k, a, b in rows}
    for _ in range(2):
        got = table.rewarded(df, ["prompt", "completion"], score).collect()
        assert {r["reward_key"]: r["reward"] for r in got} == want
        assert asked.value == len({r[1:] for r in rows})
    more = df.unionByName(spark.createDataFrame([(999, "new", "one")], df.schema))
    assert table.rewarded(more, ["prompt", "completion"], score).count() == 201 and asked.value == len({r[1:] for r in rows}) + 1


def test_the_last_reward_counts_and_versions_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rewards, "MOST_VERSIONS", 3)
    table = rewards.RewardTable(spark, str(tmp_path / "r"))
    for v in range(6):
        table.put(spark.createDataFrame([("same", float(v)), (f"k{v}", 1.0)], "key string, reward double"))
    assert {r["key"]: r["reward"] for r in table.rows().collect()} == {"same": 5.0} | {f"k{v}": 1.0 for v in range(6)}
    assert len(table._versions()) <= 3
    os.remove(tmp_path / "r" / f"version={table._versions()[-1]}" / "_SUCCESS")  # as a killed run leaves it
    assert {r["key"]: r["reward"] for r in table.rows().collect()}["same"] < 5.0


def slot(prefix, fail_at=None):
    def generate(prompts):
        if fail_at and any(fail_at in p for p in prompts):
            raise RuntimeError("killed")
        return ["too short" if "short" in p or (prefix == "better" and "plain" in p) else f"{prefix} one two three four five six seven eight {p[:9]}" for p in prompts]

    return generate


def test_a_killed_chain_goes_on(spark, tmp_path):
    rows = [(k, f"prompt {k} " + random.Random(k).choice(["", "short", "plain"])) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, prompt string")
    path, log = str(tmp_path / "chain"), spark.sparkContext.accumulator(0)
    with pytest.raises(Exception, match="killed"):
        chain.drafted_and_improved(df, "id", "prompt", slot("draft", "prompt 12 "), slot("better"), path)
    before = chain.committed(spark, path)
    assert len(before) < 8

    plain = slot("draft")

    def counted(prompts):
        log.add(len(prompts))
        return plain(prompts)

    got = chain.drafted_and_improved(df, "id", "prompt", counted, slot("better"), path).collect()
    again = [r["k"] for r in df.select(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(8)).alias("k")).collect() if r["k"] not in before]
    assert log.value == len(again) > 0
    assert sorted(r["id"] for r in got) == [k for k, p in rows if "short" not in p]
    assert all(r["final_answer"].startswith("draft" if "plain" in r["prompt"] else "better") for r in got)
    assert len(chain.committed(spark, path)) == 8
    assert chain.drafted_and_improved(df, "id", "prompt", slot("draft", "prompt"), slot("better"), path).count() == len(got)
