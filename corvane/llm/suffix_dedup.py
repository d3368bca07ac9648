"""Removal of long byte strings seen before, with a logarithmic family of suffix arrays.

A byte goes if a string of ``LEAST`` bytes that covers it also starts earlier: in a
document of a smaller id, or further ahead in the same one.

*Suffix arrays.*  Of each string of ``LEAST`` bytes (a window) the least hash of its
``ANCHOR``-byte parts picks one place, so equal windows pick the same place in them, and
about one suffix in 31 is taken.  A suffix is kept with all windows that picked it, which
follow one another (a run): by a fingerprint of its first ``ANCHOR`` bytes, one of its
run's bytes, and where the run is.  Arrays are sorted by these fingerprints, since a
merge scan needs equal prefixes side by side, not the order of different ones.

*Levels.*  Documents come in batches by rising id.  A batch's array is a bucketed, sorted
table; it is merge-scanned against each older level (sorted buckets that are read as they
lie, never shuffled again), levels of as many batches are merged before the next batch is
added, and a level holds each run once, where it comes first.

*Matches.*  A run that a level or the batch has at an earlier place goes as a whole: all
its windows do.  A run that is new, but whose anchor has other runs as well, is at the
edge of a match; its windows are compared one by one, by fingerprints of their bytes and
the anchor's (128 bits together).  Anchors of more than ``HOT`` runs are dealt out by
window, all others by anchor.  Repeats among the texts of one task are settled there, so
a string that a third of the documents hold brings as many rows as there are tasks' blocks.

Defined results: a null text is empty; a null id counts as the largest; rows of one id
stand in the order of a hash of their texts, and equal rows (id and text) are one
document; empty and short texts (under ``LEAST`` bytes) stay whole; very long texts are
read in overlapping pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm._shared import delete_path, shared_path, small_batches, staged
from corvane.llm._words import mix

LEAST, ANCHOR = 100, 32
BATCHES = 4
HOT, SALTS = 4096, 64
#: Bytes hashed at a time, bytes of a piece of a text, runs settled in a task at a time.
BLOCK, PIECE, HELD = 1 << 19, 1 << 19, 1 << 19
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_HIGH, _LOW, _HALF = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(32)
_COUNT = 128  # a place is start * _COUNT + the number of windows
_PLACE = ["id", "sub", "at"]


def _parts(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on; ``data`` has that many bytes to spare."""
    lanes = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), shape=(len(data) - 8,), strides=(1,))
    h, width = mix(lanes + _C1), 8
    while width < ANCHOR:
        h, width = mix(h[:-width] * _C1 + h[width:]), 2 * width
    return h


def _windows(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the LEAST bytes from the places on."""
    out = h[at]
    for step in (*range(ANCHOR, LEAST - ANCHOR, ANCHOR), LEAST - ANCHOR):
        out = mix(out * _C2 + h[at + step])
    return out


def _runs(data: np.ndarray, lo: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts at ``lo``: (text, start, windows, anchor, fingerprint)."""
    h = _parts(data)
    least = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first place
    width = LEAST - ANCHOR + 1
    done = 1
    while 2 * done <= width:
        least, done = np.minimum(least[:-done], least[done:]), 2 * done
    if done < width:
        least = np.minimum(least[: done - width], least[width - done :])
    picked = (least & _LOW).astype(np.int64)
    count = np.maximum(lens - LEAST + 1, 0)
    has = np.flatnonzero(count)
    where = np.repeat(lo[has] - (np.cumsum(count[has]) - count[has]), count[has]) + np.arange(count.sum())
    text = np.repeat(has, count[has])
    own = picked[where]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(own)))
    start = where[head]
    print_ = mix(_windows(h, start) * _C1 + _windows(h, start + n - 1) * _C2 + n.astype(np.uint64))
    return text[head], start - lo[text[head]], n, mix(h[own[head]] ^ _C3), print_


def _pieces(batches):
    """(id, sub, offset, bytes) of texts, long ones in pieces that share LEAST - 1 bytes."""
    for batch in batches:
        for i, sub, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for lo in range(0, max(len(text) - LEAST + 1, 0), PIECE):
                yield i, sub, lo, text[lo : lo + PIECE + LEAST - 1]


def _settled(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of (anchor, print, id, sub, at): equal rows once, and whether an earlier place has the
    same anchor and print; such rows take a random anchor, as they meet nothing any more."""
    order = np.lexsort(columns[::-1])
    anchor, print_, *place = (c[order] for c in columns)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (print_[1:] != print_[:-1])
    fresh = new.copy()
    for c in place:
        fresh[1:] |= c[1:] != c[:-1]
    keep = np.flatnonzero(fresh)
    copy = ~new[keep]
    # an equal place that comes again is no copy of itself: it is not among fresh ones
    anchor, print_, *place = (c[keep] for c in (anchor, print_, *place))
    anchor = np.where(copy, mix(place[0].view(np.uint64) * _C1 + place[2].view(np.uint64)), anchor)
    return [anchor, print_, *place, copy]


_ENTRY = "anchor long, print long, id long, sub long, at long, copy boolean"


def _entry_batches(columns: list[np.ndarray]):
    made = _settled(columns)
    arrays = [*(pa.array(c.view(np.int64)) for c in made[:5]), pa.array(made[5])]
    whole = pa.RecordBatch.from_arrays(arrays, ["anchor", "print", *_PLACE, "copy"])
    for lo in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(lo, 1 << 16)


def sampled_suffixes(docs: DataFrame) -> DataFrame:
    """docs: id, sub, bytes; a row for each run, and whether its task has it at an earlier place."""

    def run(batches):
        held, size = [], 0
        block, room = [], 0

        def hashed():
            lens = np.fromiter((len(x[3]) for x in block), np.int64, len(block))
            data = np.frombuffer(b"".join(x[3] for x in block) + bytes(ANCHOR + LEAST), np.uint8)
            text, start, n, anchor, print_ = _runs(data, np.cumsum(lens) - lens, lens)
            ids, subs, base = (np.fromiter((x[k] for x in block), np.int64, len(block))[text] for k in range(3))
            return anchor, print_, ids, subs, (base + start) * _COUNT + n

        for piece in _pieces(batches):
            block.append(piece)
            room += len(piece[3])
            if room >= BLOCK:
                held.append(hashed())
                size += len(held[-1][0])
                block, room = [], 0
                if size >= HELD:
                    yield from _entry_batches([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, size = [], 0
        if block:
            held.append(hashed())
        if held:
            yield from _entry_batches([np.concatenate(c) for c in zip(*held, strict=True)])

    return docs.select("id", "sub", "bytes").mapInArrow(run, _ENTRY)


#: Buckets keep their order and serve joins by more columns; finished shuffles leave the disk.
_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]):
    """Settings for the writes of a block; afterwards the session has its own again."""
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        with small_batches(spark):
            yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class SuffixLevels:
    """Levels of batches' suffix arrays: tables (anchor, print, id, sub, at, cut), bucketed by
    the anchor and sorted.  Rows with ``cut`` are of their batch's result, not of the level."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.cuts, self.asks = spark, [], [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made: list[tuple[str, str]] = []

    def _store(self, df: DataFrame) -> str:
        name, path = f"corvane_{uuid.uuid4().hex}", shared_path(self.spark, "level")
        df.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor", "print").option("path", path).saveAsTable(name)
        self.made.append((name, path))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        for n, path in self.made:
            if n == name:
                delete_path(self.spark, path)

    def _rows(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not cut")

    def _compact(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels[-2:]
            merged = self._store(self._rows(a).unionByName(self._rows(b)).repartition(self.buckets, "anchor"))
            self.levels[-2:] = [(n + m, merged)]
            self._drop(a)
            self._drop(b)

    def add(self, docs: DataFrame) -> None:
        """docs: id, sub, bytes, all of later ids than any before."""
        self._compact()
        same = Window.partitionBy("anchor", "print").orderBy(*_PLACE)
        place = F.struct(*_PLACE)
        rows = sampled_suffixes(docs).repartition(self.buckets, "anchor")
        rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("head", F.first(place).over(same)).withColumn("cut", F.col("copy") | (F.col("head") != place))
        rows = rows.where("cut or nth = 1").select("anchor", "print", *_PLACE, "cut")
        for _, level in self.levels:
            old = self._rows(level).select("anchor", "print", F.lit(True).alias("known")).hint("merge")
            rows = rows.join(old, ["anchor", "print"], "left").withColumn("cut", F.col("cut") | F.coalesce("known", F.lit(False))).drop("known")
        name = self._store(rows)
        self.cuts.append(staged(self.spark.table(name).where("cut").select(*_PLACE), "cuts"))
        fresh = self._rows(name)
        several = fresh.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        asked = fresh.join(several.hint("merge"), "anchor", "left_semi")
        for _, level in self.levels:
            old = self._rows(level)
            asked = asked.unionByName(old.join(fresh.select("anchor").hint("merge"), "anchor", "left_semi")).unionByName(fresh.join(old.select("anchor").hint("merge"), "anchor", "left_semi"))
        self.asks.append(staged(asked.select("anchor", *_PLACE), "asks"))
        self.levels.append((1, name))

    def close(self) -> None:
        for _, name in self.levels:
            self._drop(name)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as separate ones."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    head = np.flatnonzero(new)
    return starts[head], ends[np.append(head[1:], len(starts)) - 1]


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, spans, what is left)."""
    if not len(starts):
        return 0, 0, text
    a, b = _spans(starts, ends)
    rest = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
    return len(text) - len(rest), len(a), rest


def _run_spans(at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(at, np.int64)
    start = at // _COUNT
    return start, start + at % _COUNT + LEAST - 1


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_CONTEXT = "array<struct<anchor: long, hot: boolean, at: long, bytes: binary>>"


def _result_arrays(some: list[tuple], texts: bool) -> list[pa.Array]:
    sizes, made = [x[0] for x in some], [x[1] for x in some]
    return [
        pa.array(sizes, pa.int64()), *(pa.array([None if m is None else m[k] for m in made], pa.int64()) for k in (0, 1)),
        pa.array([None if m is None else hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()), pa.array([m[2] if m and texts else None for m in made], pa.binary()),
    ]


def _first_pass(docs: DataFrame, lists: DataFrame, texts: bool) -> DataFrame:
    """Documents that nothing is to be asked of are done; the others bring the bytes of their
    questions along, and themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    context = pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.bool_()), ("at", pa.int64()), ("bytes", pa.binary())]))
    met = docs.join(lists, ["id", "sub"], "left").select("doc_id", "id", "sub", "bytes", "cuts", "asks")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                done, left, asked = [], [], []
                for text, cuts, asks in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                    done.append((len(text), None if asks else _kept(text, *_run_spans(cuts or []))))
                    left.append(text if asks else None)
                    asked.append([x | {"bytes": text[x["at"] // _COUNT : x["at"] // _COUNT + x["at"] % _COUNT + LEAST - 1]} for x in asks] if asks else None)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), *_result_arrays(done, texts), pa.array(left, pa.binary()), pa.array([c if t is not None else None for c, t in zip(part.column(4).to_pylist(), left, strict=True)], pa.list_(pa.int64())), pa.array(asked, context)],
                    ["doc_id", "id", "sub", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "bytes", "cuts", "asked"],
                )

    return met.mapInArrow(run, f"doc_id {kind}, id long, sub long, {_RESULT}, bytes binary, cuts array<long>, asked {_CONTEXT}")


def _unfolded(rows: list[tuple]) -> list[np.ndarray]:
    """(anchor, print, id, sub, start) of all windows of runs (anchor, id, sub, at, bytes)."""
    at = np.array([r[3] for r in rows], np.int64)
    n = at % _COUNT
    lens = n + LEAST - 1
    lo = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(r[4] for r in rows) + bytes(ANCHOR + LEAST), np.uint8)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    print_ = _windows(_parts(data), np.repeat(lo, n) + step)
    anchor, ids, subs = (np.repeat(np.array([r[k] for r in rows], np.int64), n) for k in range(3))
    return [anchor.view(np.uint64), print_, ids, subs, np.repeat(at // _COUNT, n) + step]


def _seen_windows(asked: DataFrame) -> DataFrame:
    """(id, sub, at) of single windows that start earlier somewhere; at as a run of one window."""
    cold = asked.where("not hot").select("anchor", *_PLACE, "bytes").repartition("anchor").sortWithinPartitions("anchor")
    hot = asked.where("hot").select("anchor", *_PLACE, "bytes")

    def by_anchor(batches):
        held, size = [], 0

        def settled():
            made = _settled(_unfolded(held))
            cut = made[5]
            return pa.RecordBatch.from_arrays([pa.array(made[2][cut]), pa.array(made[3][cut]), pa.array(made[4][cut] * _COUNT + 1)], _PLACE)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and held[-1][0] != row[0]:
                    yield settled()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settled()

    def by_window(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                yield from _entry_batches(_unfolded(list(zip(*(c.to_pylist() for c in batch.slice(lo, 4096).columns), strict=True))))

    same = Window.partitionBy("anchor", "print").orderBy(*_PLACE)
    place = F.struct(*_PLACE)
    dealt = hot.mapInArrow(by_window, _ENTRY).withColumn("head", F.first(place).over(same)).where(F.col("copy") | (F.col("head") != place))
    return cold.mapInArrow(by_anchor, "id long, sub long, at long").unionByName(dealt.select("id", "sub", (F.col("at") * _COUNT + 1).alias("at")))


def suffix_dedup(docs: DataFrame, texts: bool = False, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept``, what is
    left as bytes, only where ``texts`` is asked for, else null."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), text.alias("text"))
    repeated = named.groupBy("id").agg(F.count("*").alias("n"), F.count("doc_id").alias("some")).where("n > 1 or some = 0").limit(1).count() > 0
    named = named.select("doc_id", "id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("sub"), F.col("text").cast("binary").alias("bytes"))
    with _settings(spark, _BUCKETS | _TIDY):
        bounds = sorted(set(named.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] or [])) if batches > 1 else []
        levels = SuffixLevels(spark)
        for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
            some = named if lo is None else named.where(F.col("id") > lo)
            levels.add(some if hi is None else some.where(F.col("id") <= hi))
        levels.close()
    with _settings(spark, _TIDY):
        cuts, asks = levels.cuts[0], levels.asks[0]
        for c, a in zip(levels.cuts[1:], levels.asks[1:], strict=True):
            cuts, asks = cuts.unionByName(c), asks.unionByName(a)
        asks = staged(asks.distinct(), "asks")
        # a hot anchor has over HOT rows, so its one row can be repeated for each salt
        hot = asks.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        asks = asks.withColumn("salt", F.pmod(F.xxhash64(*_PLACE), F.lit(SALTS)).cast("int")).join(hot, ["anchor", "salt"], "left").select(*_PLACE, "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
        ask = F.when(F.col("anchor").isNotNull(), F.struct("anchor", "hot", "at"))
        both = cuts.select(*_PLACE, F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("boolean").alias("hot")).unionByName(asks)
        lists = both.groupBy("id", "sub").agg(F.collect_list(F.when(F.col("anchor").isNull(), F.col("at"))).alias("cuts"), F.collect_list(ask).alias("asks"))
        first = staged(_first_pass(named, lists, texts), "first")
        seen = _seen_windows(first.select("id", "sub", F.inline("asked"))).groupBy("id", "sub").agg(F.collect_list("at").alias("more")).distinct()
        rest = first.where("bytes is not null").select("doc_id", "id", "sub", "bytes", "cuts").join(seen, ["id", "sub"], "left").select("doc_id", "bytes", "cuts", "more")
        kind = docs.schema[id_col].dataType.simpleString()

        def finish(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 100):
                    part = batch.slice(lo, 100)
                    done = [(len(t), _kept(t, *_run_spans([*(c or []), *(m or [])]))) for t, c, m in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *_result_arrays(done, texts)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        last = staged(rest.mapInArrow(finish, f"doc_id {kind}, {_RESULT}"), "last")
    return first.where("bytes is null").select(last.columns).unionByName(last)
