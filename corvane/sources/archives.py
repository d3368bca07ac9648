"""ZIP archives by ranged reads: the directory of each, then only the members that are needed.

A task that lists an archive reads its central directory and no member; the members asked
for are joined to the listing, dealt over tasks by archive and place, and read range by
range.  No archive is ever held whole, so archives of any size are read, and what is read
shrinks with what is needed.  What can't be read becomes a row that says why.
"""

from __future__ import annotations

import struct
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members that lie so near each other are read together, up to so many bytes at once.
NEAR, AT_ONCE = 1 << 16, 1 << 24
_HEAD = 30  # bytes of a member's own header before its name
_STORED, _DEFLATED, _LOCKED = 0, 8, 1
_LISTED = "archive string, member string, file_path string, place long, packed long, size long, method int, flags int, crc long, error string"
_READ = "archive string, file_path string, text string, bytes_read long, error string"


def _opened(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), like, strict=True)], schema=like)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def archive_paths(spark: SparkSession, path: str) -> DataFrame:
    """(archive): the files of a glob; they are listed, not read.  A task takes many of them, as each
    task tells the driver some kilobytes about itself."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath) or []
    names = [(s.getPath().toString(),) for s in found if s.isFile()]
    return spark.createDataFrame(names, "archive string").repartition(max(1, min(len(names), int(spark.conf.get("spark.sql.shuffle.partitions")))))


def archive_listing(archives: DataFrame) -> DataFrame:
    """A row for each file in each archive, from the directories alone; ``file_path`` is without
    the first segment.  An archive without a directory gives one row with an error."""
    like = _schema(_LISTED)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as f, zipfile.ZipFile(f) as z:
                        infos = z.infolist()
                    rows = [(name, i.filename, i.filename.partition("/")[2], i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC, None) for i in infos if not i.is_dir() and i.filename.partition("/")[2]]
                except (zipfile.BadZipFile, OSError, struct.error, ValueError) as e:
                    rows = [(name, *(None,) * 8, f"directory: {e}")]
                for lo in range(0, len(rows), 10_000):
                    yield _batch(rows[lo : lo + 10_000], like)

    return archives.select("archive").mapInArrow(run, _LISTED)


def _unpacked(data: bytes, place: int, packed: int, size: int, method: int, flags: int, crc: int) -> bytes:
    """A member's content; ``data`` begins at its own header and holds the member whole."""
    if flags & _LOCKED:
        raise ValueError("member is encrypted")
    if data[:4] != b"PK\x03\x04":
        raise ValueError("no member where the directory has one")
    name, extra = struct.unpack("<HH", data[26:_HEAD])
    raw = data[_HEAD + name + extra :][:packed]
    if len(raw) < packed:
        raise ValueError("member ends early")
    if method == _DEFLATED:
        raw = zlib.decompressobj(-15).decompress(raw)
    elif method != _STORED:
        raise ValueError(f"packing method {method}")
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError("checksum differs")
    return raw


def _end(row: tuple) -> int:
    """Where a listed member ends, if its own header is as long as members' mostly are."""
    return row[3] + _HEAD + len(row[1].encode("utf-8", "replace")) + 64 + row[4]


def _whole(data: bytes, packed: int) -> int:
    """Bytes of a member and its own header, which may hold more than the directory says."""
    return _HEAD + sum(struct.unpack("<HH", data[26:_HEAD])) + packed if data[:4] == b"PK\x03\x04" and len(data) >= _HEAD else 0


def _ranges(rows: list[tuple]):
    """Members of one archive that are read together; rows are in the order of their places."""
    group, end = [], 0
    for r in rows:
        if group and (r[3] - end > NEAR or r[3] + r[4] - group[0][3] > AT_ONCE):
            yield group
            group = []
        group.append(r)
        end = r[3] + r[4] + _HEAD
    if group:
        yield group


def read_members(listing: DataFrame) -> DataFrame:
    """(archive, file_path, text, bytes_read, error) of listed members, decoded with replacement;
    ``bytes_read`` is what the range read for a member (its first one has it all) came to."""
    like = _schema(_READ)
    ordered = listing.where("error is null").repartitionByRange("archive", "place").sortWithinPartitions("archive", "place")

    def read(rows):
        with _opened(rows[0][0]) as f:
            total = f.size()
            for group in _ranges(rows):
                lo = group[0][3]
                hi = min(total, max(_end(r) for r in group))
                data, counted = memoryview(f.read_at(hi - lo, lo)), hi - lo
                for r in group:
                    try:
                        own = bytes(data[r[3] - lo : _end(r) - lo])
                        if (more := _whole(own, r[4]) - len(own)) > 0:
                            own += f.read_at(more, r[3] + len(own))
                            counted += more
                        text, error = _unpacked(own, *r[3:9]).decode("utf-8", "replace"), None
                    except (ValueError, zlib.error, struct.error) as e:
                        text, error = None, f"member: {e}"
                    yield r[0], r[2], text, counted, error
                    counted = 0

    def run(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            edges = [0, *(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0]), len(rows)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                some, size = [], 0
                for row in read(rows[lo:hi]) if hi > lo else ():
                    some.append(row)
                    size += len(row[2] or "")
                    if size > AT_ONCE:
                        yield _batch(some, like)
                        some, size = [], 0
                if some:
                    yield _batch(some, like)

    return ordered.mapInArrow(run, _READ).unionByName(listing.where("error is not null").select("archive", "file_path", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("bytes_read"), "error"))


def archive_members(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """read_members of the archives of a glob; with ``needed`` (archive, file_path) only of those,
    and archives that nothing is needed of are not even listed."""
    archives = archive_paths(spark, path)
    if needed is None:
        return read_members(archive_listing(archives))
    needed = needed.where("archive is not null and file_path is not null").select("archive", "file_path").distinct()
    listing = archive_listing(archives.join(needed.select("archive").distinct(), "archive", "left_semi"))
    found = listing.where("error is null").join(needed, ["archive", "file_path"], "left_semi")
    return read_members(found.unionByName(listing.where("error is not null"), allowMissingColumns=True).select(listing.columns))
