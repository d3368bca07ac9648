"""Archives by ranged reads."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import archives, readers


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED if a else zipfile.ZIP_STORED) as z:
            z.writestr("repo/", "")
            for k in range(40):
                z.writestr(f"repo/src/é{k}.py", f"{a} {k} é " + "".join(chr(rng.randint(32, 126)) for _ in range(20_000)))
    return tmp_path


def contents(folder):
    out = {}
    for path in sorted(folder.glob("*.zip")):
        with zipfile.ZipFile(path) as z:
            out |= {(path.name, i.filename.partition("/")[2]): z.read(i).decode() for i in z.infolist() if not i.is_dir()}
    return out


def read(df):
    return {(r["archive"].rpartition("/")[2], r["file_path"]): r["text"] for r in df.collect()}


def test_all_members(spark, folder):
    assert read(readers.archive_texts(spark, f"{folder}/*.zip")) == contents(folder)


def test_bytes_read_shrink_with_what_is_needed(spark, folder):
    names = archives.archive_paths(spark, f"{folder}/*.zip")
    total = sum(p.stat().st_size for p in folder.glob("*.zip"))
    for share in (1, 5, 20):
        needed = names.where("archive like '%1.zip'").select("archive", F.explode(F.array(*(F.lit(f"src/é{k}.py") for k in range(0, 40, share)))).alias("file_path"))
        needed = needed.unionByName(needed.select("archive", F.lit("src/none.py").alias("file_path")))
        got = archives.archive_members(spark, f"{folder}/*.zip", needed)
        want = {k: v for k, v in contents(folder).items() if k[0] == "1.zip" and int(k[1][5:-3]) % share == 0}
        assert read(got) == want
        assert got.agg(F.sum("bytes_read")).first()[0] < total / 3 / share * 1.2 + 2000


def test_what_cannot_be_read_says_why(spark, folder):
    raw = (folder / "0.zip").read_bytes()
    at = raw.index(b"0 7 ")
    (folder / "0.zip").write_bytes(raw[:at] + b"X" + raw[at + 1 :])
    (folder / "2.zip").write_bytes((folder / "2.zip").read_bytes()[:-30])
    (folder / "3.zip").write_bytes(b"no archive")
    want = {k: v for k, v in contents_of(folder, "1.zip").items()}
    got = archives.archive_members(spark, f"{folder}/*.zip")
    errors = sorted((r["archive"].rpartition("/")[2], r["file_path"], r["error"].partition(":")[0]) for r in got.where("error is not null").collect())
    assert errors == [("0.zip", "src/é7.py", "member"), ("2.zip", None, "directory"), ("3.zip", None, "directory")]
    fine = read(got.where("error is null"))
    assert len(fine) == 79 and {k: v for k, v in fine.items() if k[0] == "1.zip"} == want


def contents_of(folder, name):
    with zipfile.ZipFile(folder / name) as z:
        return {(name, i.filename.partition("/")[2]): z.read(i).decode() for i in z.infolist() if not i.is_dir()}


def test_large_own_headers_and_no_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        info = zipfile.ZipInfo("repo/a.py")
        info.extra = b"\xfe\xca" + (3000).to_bytes(2, "little") + bytes(3000)
        z.writestr(info, "text of it")
    assert read(readers.archive_texts(spark, f"{tmp_path}/a.zip")) == {("a.zip", "a.py"): "text of it"}
    assert readers.archive_texts(spark, f"{tmp_path}/none*.zip").collect() == []
