"""Chroma audio fingerprints, their index, and the alignment of recordings.

A recording (mono 16-bit PCM) becomes frames of twelve pitch-class energies, smoothed
over time and normalised.  Sixteen rectangle filters, evaluated on an integral image of
the frames, are cut into four steps each (two bits, Gray code), which packs a frame
into a 32-bit integer.  All recordings are indexed by the upper ``KEY_BITS`` bits of their
integers; of a run of equal keys the first place stands for all.  A query's frames vote for
(recording, offset) by keys that are equal or one bit away; every offset with a vote is then
checked by the share of differing bits over the whole overlap.

Two recordings are linked when at an offset that overlaps half of the shorter one at most
``MOST_ERRORS`` of the bits differ.  The bound and the keys belong together: of 24 bits that
differ with a chance of 0.2 each, at most one does in 3.3 of a hundred places, so 107 places
hold such a key with a chance of 0.97, and differences that come in bursts leave more.  With
0.3 it would be 0.2, and unrelated recordings begin to come that near by chance.

Recordings with equal fingerprints form a class (its smallest id stands for it), so
copies are indexed once.  ``search`` gives the links between classes, ``link_counts`` one
row for each query with the number of recordings that it is linked with.

Defined results: null, empty or too short recordings (below ``MIN_FRAMES`` frames) have
an empty fingerprint and match nothing; silence has frames of zeros, which tell nothing and
cast no votes, so a silent recording matches its own class only; rows with a null id
are ignored; a repeated id counts with each of its recordings; an empty table gives an
empty table; extra columns are not carried.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import staged

RATE, FRAME, HOP = 4096, 2048, 512
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16
MIN_FRAMES = WIDTH + len(SMOOTHING) - 1
KEY_BITS = 24
#: Filter values are counted in steps of 1/STEPS; they stay within log(1 + 12 * WIDTH) of zero.
STEPS, COARSE = 4096, 256
SPAN = 2 * STEPS * 6
SPLITS = 8
MOST_ERRORS = 0.2
#: Frames whose spectra are held at once.
FRAMES_AT_ONCE = 4096


@functools.lru_cache(maxsize=1)
def _pitch_matrix() -> np.ndarray:
    """Spectrum bins to pitch classes, from 55 Hz to half the rate."""
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(freq), 12))
    use = np.flatnonzero((freq >= 55) & (freq < RATE / 2))
    out[use, np.round(12 * np.log2(freq[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) smoothed, normalised pitch-class energies."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < MIN_FRAMES:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    window, pitch, energy = np.hanning(FRAME).astype(np.float32), _pitch_matrix(), np.empty((n, 12))
    for lo in range(0, n, FRAMES_AT_ONCE):
        part = frames[lo : lo + FRAMES_AT_ONCE].astype(np.float32)
        energy[lo : lo + len(part)] = np.abs(np.fft.rfft(part * window, axis=1)) ** 2 @ pitch
    k = len(SMOOTHING)
    smooth = sum(w * energy[i : n - k + 1 + i] for i, w in enumerate(SMOOTHING))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-3), 0.0)


@functools.lru_cache(maxsize=1)
def filter_bank() -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first class, classes, frames) by rule: six kinds of rectangle
    differences over falling sizes."""
    sizes = [(12, 16), (6, 16), (4, 12), (3, 8), (6, 8), (4, 4)]
    return [(k % 6, (5 * k) % (12 - sizes[(k * 7 + k // 6) % 6][0] + 1), *sizes[(k * 7 + k // 6) % 6]) for k in range(16)]


def responses(image: np.ndarray) -> np.ndarray:
    """(positions, 16) filter values of a chroma image by its integral image."""
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(len(image) - WIDTH + 1)

    def area(t0, t1, c0, c1):
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.empty((len(at), 16))
    for k, (kind, c, h, w) in enumerate(filter_bank()):
        hh, hw, th = h // 2, w // 2, h // 3
        if kind == 0:
            a, b = area(0, w, c, c + hh), area(0, w, c + hh, c + h)
        elif kind == 1:
            a, b = area(0, hw, c, c + h), area(hw, w, c, c + h)
        elif kind == 2:
            a, b = area(0, hw, c, c + hh) + area(hw, w, c + hh, c + h), area(hw, w, c, c + hh) + area(0, hw, c + hh, c + h)
        elif kind == 3:
            a, b = area(0, w, c + th, c + h - th), area(0, w, c, c + th) + area(0, w, c + h - th, c + h)
        elif kind == 4:
            q = max(1, w // 4)
            a, b = area(q, w - q, c, c + h), area(0, q, c, c + h) + area(w - q, w, c, c + h)
        else:
            a, b = area(0, w, c, c + 1), area(0, w, (c + h) % 12, (c + h) % 12 + 1)
        out[:, k] = np.log1p(a) - np.log1p(b)
    return out


def pack(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Four steps a filter, Gray-coded, packed into uint32; cuts: (16, 3)."""
    step = (values[:, :, None] > cuts[None]).sum(2)
    gray = (step ^ (step >> 1)).astype(np.uint32)
    out = np.zeros(len(values), np.uint32)
    for k in range(16):
        out = (out << np.uint32(2)) | gray[:, k]
    return out


def fingerprint(pcm: bytes | None, cuts: np.ndarray) -> np.ndarray:
    image = chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2")) if pcm else np.zeros((0, 12))
    return pack(responses(image), cuts) if len(image) >= WIDTH else np.zeros(0, np.uint32)


def fit_cuts(df: DataFrame, id_col: str, pcm_col: str) -> np.ndarray:
    """Quartiles of each filter over every place of all recordings with an id, rounded up to
    steps of 1/STEPS.  Values are counted by step; only the counts of COARSE steps, and of the
    steps in those that hold a quartile, come to the driver: both are bounded by the range of
    the values."""

    def run(batches):
        counts = np.zeros(16 * SPAN, np.int64)
        for batch in batches:
            for pcm in batch.column(0):
                pcm = pcm.as_py()
                image = chroma(np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2")) if pcm else np.zeros((0, 12))
                if len(image) >= WIDTH:
                    step = np.ceil(responses(image) * STEPS).astype(np.int64) + SPAN // 2
                    at, n = np.unique(step + SPAN * np.arange(16), return_counts=True)
                    counts[at] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at // SPAN).astype(np.int32)), pa.array((at % SPAN - SPAN // 2).astype(np.int32)), pa.array(counts[at])], ["k", "step", "n"])

    told = df.where(F.col(id_col).isNotNull()).select(pcm_col).mapInArrow(run, "k int, step int, n long")
    told = staged(told.groupBy("k", "step").agg(F.sum("n").alias("n")), "steps")
    coarse = F.floor(F.col("step") / COARSE).cast("int")
    wide = sorted(told.groupBy("k", coarse.alias("c")).agg(F.sum("n").alias("n")).collect())
    if not wide:
        return np.zeros((16, 3))
    asked, cuts = [], np.zeros((16, 3))
    for k in range(16):
        mine = [r for r in wide if r["k"] == k]
        ends = np.cumsum([r["n"] for r in mine])
        for q in range(3):
            # the quartile is the value of this rank
            rank = -(-int(ends[-1]) * (q + 1) // 4)
            at = int(np.searchsorted(ends, rank))
            asked.append((k, q, mine[at]["c"], rank - int(ends[at] - mine[at]["n"])))
    near = told.where(F.struct("k", coarse).isin([F.struct(F.lit(k), F.lit(c)) for k, _, c, _ in asked]))
    fine = sorted(near.collect())
    for k, q, c, rank in asked:
        mine = [r for r in fine if r["k"] == k and r["step"] // COARSE == c]
        cuts[k, q] = mine[int(np.searchsorted(np.cumsum([r["n"] for r in mine]), rank))]["step"] / STEPS
    return cuts


def fingerprints(df: DataFrame, cuts: np.ndarray, id_col: str = "id", pcm_col: str = "pcm") -> DataFrame:
    """(id, prints): little-endian uint32 integers, one a position."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(pcm_col).alias("pcm")).where("id is not null")

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x, cuts).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["id", "prints"])

    return source.mapInArrow(run, "id long, prints binary")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where b, moved by offset, overlaps a; and the overlap."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()) / (32 * (hi - lo)), hi - lo


def silent_print(cuts: np.ndarray) -> int:
    """The integer of a place where nothing sounds."""
    return int(pack(np.zeros((1, 16)), cuts)[0])


def _keys(prints: DataFrame, silent: int | None, probes: bool = False) -> DataFrame:
    """(class, key, at): of the index the first place of each run of equal keys; with
    probes every place, and also the keys one bit away: in Gray code that is one filter
    value on the other side of one cut."""
    flips = np.array([0, *(1 << b for b in range(KEY_BITS))] if probes else [0], np.int32)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, keys, at = [], [], []
                for i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    whole = np.frombuffer(raw, "<u4")
                    own = (whole >> np.uint32(32 - KEY_BITS)).astype(np.int32)
                    use = np.ones(len(own), bool) if probes else np.diff(own, prepend=own[:1] ^ 1) != 0
                    if silent is not None:
                        use &= whole != silent
                    spots = np.flatnonzero(use).astype(np.int32)
                    ids.append(np.full(len(spots) * len(flips), i, np.int64))
                    keys.append((own[spots][:, None] ^ flips).ravel())
                    at.append(np.repeat(spots, len(flips)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, at)], ["class", "key", "at"])

    return prints.mapInArrow(run, "class long, key int, at int")


def _classes(prints: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the recordings (id, class) and of the classes (class, prints, rep, size, asked);
    asked is the number of queries among the recordings."""
    known = staged(prints.where(F.length("prints") > 0).withColumn("class", F.xxhash64("prints")), "prints")
    own = known.groupBy("class", "prints").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("asked"))
    return known.select("id", "class"), staged(own, "classes")


def _aligned(classes: DataFrame, silent: int | None, most_errors: float, least_overlap: float) -> DataFrame:
    """(q, class, offset, votes, bit_error): links of the classes that hold a query with other classes."""
    index = _keys(classes.select("class", "prints"), silent).withColumn("salt", F.pmod("class", F.lit(SPLITS)).cast("int"))
    asked = _keys(classes.where("asked > 0").select("class", "prints"), silent, probes=True).select(F.col("class").alias("q"), "key", F.col("at").alias("q_at"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    votes = asked.join(index, ["key", "salt"]).where("q <> class").groupBy("q", "class", (F.col("q_at") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
    # no more offsets than both recordings have places
    found = votes.groupBy("q", "class").agg(F.collect_list(F.struct("offset", "votes")).alias("offsets"))
    left = classes.where("asked > 0").select(F.col("class").alias("q"), F.col("prints").alias("a"))
    right = classes.select("class", F.col("prints").alias("b"))
    pairs = found.join(left, "q").join(right, "class").select("q", "class", "offsets", "a", "b")

    def check(batches):
        for batch in batches:
            where, rows = [], []
            lists = batch.column(2)
            ends, (offs, counts) = lists.offsets.to_numpy(), (x.to_numpy() for x in lists.values.flatten())
            for i, (a, b) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), "<u4") for x in (a, b))
                off, votes = offs[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
                near = np.minimum(len(a), len(b) + off) - np.maximum(0, off) >= max(1, least_overlap * min(len(a), len(b)))
                best = None
                for o, v in zip(off[near].tolist(), votes[near].tolist(), strict=True):
                    error = bit_error(a, b, o)[0]
                    if error <= most_errors:
                        best = min(best or (2.0,), (error, -v, o))
                if best:
                    where.append(i)
                    rows.append(best)
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 1)), pa.array([r[2] for r in rows], pa.int32()), pa.array([-r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.float64())], ["q", "class", "offset", "votes", "bit_error"])

    return pairs.mapInArrow(check, "q long, class long, offset int, votes long, bit_error double")


def search(prints: DataFrame, every: int = 100, most_errors: float = MOST_ERRORS, least_overlap: float = 0.5, silent: int | None = None) -> DataFrame:
    """Queries (ids divisible by ``every``) against all recordings: (query_class, match_class,
    n_queries, n_matches, offset, bit_error, votes), between class representatives; n_queries and
    n_matches are the recordings of both.  A link inside one class comes with offset 0 and no error."""
    _, classes = _classes(prints, every)
    found = _aligned(classes, silent, most_errors, least_overlap)
    left = classes.select(F.col("class").alias("q"), F.col("rep").alias("query_class"), F.col("asked").alias("n_queries"))
    right = classes.select("class", F.col("rep").alias("match_class"), F.col("size").alias("n_matches"))
    names = ["query_class", "match_class", "n_queries", "n_matches", "offset", "bit_error", "votes"]
    same = classes.where("asked > 0 and size > 1").select(F.col("rep").alias("query_class"), F.col("rep").alias("match_class"), F.col("asked").alias("n_queries"), F.col("size").alias("n_matches"), F.lit(0).alias("offset"), F.lit(0.0).alias("bit_error"), F.lit(0).cast("long").alias("votes"))
    return found.join(left, "q").join(right, "class").select(*names).unionByName(same)


def link_counts(prints: DataFrame, every: int = 100, most_errors: float = MOST_ERRORS, least_overlap: float = 0.5, silent: int | None = None) -> DataFrame:
    """One row for each query: (id, class_id, n_links, n_link_classes, best_class, best_offset,
    best_bit_error).  n_links counts the other recordings it is linked with, those of its own
    class too; the best link is the one of fewest bit errors to another class."""
    members, classes = _classes(prints, every)
    found = _aligned(classes, silent, most_errors, least_overlap).join(classes.select("class", F.col("rep").alias("match"), "size"), "class")
    best = F.min(F.struct("bit_error", "match", "offset")).alias("best")
    linked = found.groupBy("q").agg(F.sum("size").alias("others"), F.count("*").alias("n_link_classes"), best)
    own = classes.where("asked > 0").join(linked.withColumnRenamed("q", "class"), "class", "left")
    own = own.select(
        "class", F.col("rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("n_link_classes", F.lit(0)).cast("long").alias("n_link_classes"),
        F.col("best.match").alias("best_class"), F.col("best.offset").alias("best_offset"), F.col("best.bit_error").alias("best_bit_error"),
    )
    asked = members.where(F.pmod("id", F.lit(every)) == 0).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SPLITS)).cast("int"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    return asked.join(own, ["class", "salt"]).drop("class", "salt")


def tones(vector: list | None, note: int = RATE // 8) -> bytes | None:
    """A recording for tables that hold vectors and no audio: one note a component,
    its pitch 24 semitones a unit around 440 Hz."""
    if not vector:
        return None
    x = np.nan_to_num(np.array(vector, np.float64), nan=0.0, posinf=1.0, neginf=-1.0)
    freq = 440 * 2 ** (np.clip(x, -1.2, 1.2) * 2)
    phase = 2 * np.pi * np.cumsum(np.repeat(freq, note)) / RATE
    return (8000 * np.sin(phase)).astype("<i2").tobytes()


def recordings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, pcm) of vectors."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tones(x) for x in part.column(1).to_pylist()], pa.binary())], ["id", "pcm"])

    return source.mapInArrow(run, "id long, pcm binary")
