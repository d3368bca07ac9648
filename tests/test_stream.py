"""Rows of a stream are appended once a key, over restarts, retries and earlier targets."""

import os

from corvane.streaming import resume

_ROW = "id long, text string"


def put(spark, path, lo, hi):
    spark.range(lo, hi).selectExpr("id", "concat('t', id) text").write.mode("append").json(path)


def run(spark, tmp_path):
    resume.append_new(spark, str(tmp_path / "in"), _ROW, str(tmp_path / "out"), str(tmp_path / "progress"), "id").awaitTermination()
    return sorted(r["id"] for r in spark.read.schema(_ROW).parquet(str(tmp_path / "out")).collect())


def test_keys_are_appended_once(spark, tmp_path):
    put(spark, str(tmp_path / "in"), 0, 50)
    assert run(spark, tmp_path) == list(range(50))
    put(spark, str(tmp_path / "in"), 30, 80)
    put(spark, str(tmp_path / "in"), 60, 70)
    assert run(spark, tmp_path) == list(range(80)) == run(spark, tmp_path)


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    """The target was written, but the kill came before the stream's own commit."""
    put(spark, str(tmp_path / "in"), 0, 50)
    run(spark, tmp_path)
    put(spark, str(tmp_path / "in"), 40, 90)
    run(spark, tmp_path)
    commits = tmp_path / "progress" / "commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for n in os.listdir(commits):
        if n.strip(".").startswith(str(last)):
            os.remove(commits / n)
    assert run(spark, tmp_path) == list(range(90))


def test_keys_of_an_earlier_target_stay_out(spark, tmp_path):
    spark.range(5, 15).selectExpr("id", "'old' text").write.parquet(str(tmp_path / "out"))
    put(spark, str(tmp_path / "in"), 0, 8)
    assert run(spark, tmp_path) == list(range(15))
    put(spark, str(tmp_path / "in"), 8, 20)
    assert run(spark, tmp_path) == list(range(20))
