"""The number of tasks that list archives does not grow with the archives."""

from corvane.sources import archives


def test_many_archives_share_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.zip").write_bytes(b"no archive")
    found = archives.archive_paths(spark, f"file:{tmp_path}/*.zip")
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 40
