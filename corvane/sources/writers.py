"""Sinks: rows are written once, by whole stages."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_json(df: DataFrame, path: str, by: str = "split") -> None:
    """One folder a split."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def object_json(df: DataFrame, path: str, key: str) -> None:
    """One object by key; meant for small tables, all of it is one value."""
    value = F.struct(*(c for c in df.columns if c != key))
    df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value)))), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def array_json(df: DataFrame, path: str) -> None:
    """One array of rows; meant for small tables, all of it is one value."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def numbers_json(df: DataFrame, path: str, key: str, value: str) -> None:
    """One object of numbers by key; meant for small tables, all of it is one value."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def zip_archives(df: DataFrame, folder: str, archive: str = "archive", path: str = "file_path", text: str = "text") -> DataFrame:
    """Writes a ZIP archive for each value of ``archive``, its files below a first segment of that
    name, and returns (archive, n_files); an archive is made in one task.  A task that is run
    again replaces its archive as a whole."""

    def write(rows: pa.Table) -> pa.Table:
        name = str(rows.column(0)[0].as_py())
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for inner, content in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                z.writestr(zipfile.ZipInfo(f"{name}/{inner}"), (content or "").encode())
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(out.getvalue())
        fs.move(own, f"{root}/{name}.zip")
        return pa.table({"archive": pa.array([name]), "n_files": pa.array([rows.num_rows], pa.int64())})

    return df.select(F.col(archive).cast("string").alias("archive"), F.col(path), F.col(text)).groupBy("archive").applyInArrow(write, "archive string, n_files long")
