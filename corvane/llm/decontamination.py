"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of word tokens (runs of letters and digits,
lower-cased).

1. Items of equal tokens count once.  Their windows of ``min_match`` tokens are the seeds.
   An item posts its rarest seeds only, so many that the others together cover less of it
   than the threshold asks for: a document without any posted seed can't reach it.
2. One pass over the documents keeps the tokens under windows that a bitmap of all seeds
   knows (of a fixed size; chance hits cost time only).  Nothing else of a text moves.
3. These meet the posted seeds by a join; distinct pairs of a document and an item are
   tiled: the longest match of tokens not yet marked is marked, again and again, matches
   being found by running Karp-Rabin hashes of falling length; ties go to the first place
   in the item, then in the text.  Tiles may come in any order, so a passage whose
   parts were reordered is found as well.  A document is contaminated when its tiles
   cover at least ``threshold`` of an item's tokens.

Neither the benchmark nor what is found in it comes to the driver, but the bitmap of
``BITMAP_BITS`` bits.

Defined results: null or empty texts hold no tokens and match nothing; items of fewer
than ``min_match`` tokens match nothing; repeated items count as one (the smallest id);
items without an id are left out; repeated documents are judged row by row; an empty
benchmark leaves every document clean; an empty table gives an empty table; extra
columns are not carried by ``contaminated`` and are kept by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import free_name, slices, small_batches, staged, text_chunks
from corvane.llm._words import chain, word_hashes

#: Bits of the table of seeds that every task holds, whatever the size of the benchmark.
BITMAP_BITS = 26
#: Bits of one row of the table while it is made.
ROW_BITS = 15
#: Rows that share a seed or an item are dealt to so many parts.
SALTS = 16
#: A side of a join is broadcast up to so many bytes by count; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Tokens of benchmark texts that a task indexes at once; results do not depend on it.
BLOCK_TOKENS = 2_000_000
_MASK = (1 << 64) - 1
_RADIX = 0x9E3779B97F4A7C15

_letters = np.zeros(0, bool)


def _letter_table() -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter(((0xD800 > c or c > 0xDFFF) and chr(c).isalnum() for c in range(0x110000)), bool)
    return _letters


def _plain(texts: list) -> list[str]:
    """Lower case; whatever is no letter or digit becomes a blank."""
    table, out = _letter_table(), []
    for t in texts:
        if t and t.isascii() is False:
            points = np.frombuffer(t.lower().encode("utf-32-le"), np.uint32)
            out.append(np.where(table[points], points, 0x20).astype(np.uint32).tobytes().decode("utf-32-le"))
        else:
            raw = np.frombuffer((t or "").lower().encode(), np.uint8)
            out.append(np.where(table[raw], raw, 0x20).astype(np.uint8).tobytes().decode())
    return out


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, and the bounds of each text."""
    return word_hashes(_plain(texts))


def _prefix(seq: list[int]) -> list[int]:
    sums = [0]
    for x in seq:
        sums.append((sums[-1] * _RADIX + x + 1) & _MASK)
    return sums


def _free_parts(item, text, free_i, free_t, p: int, q: int, n: int, least: int):
    """The stretches of a match whose tokens are not marked on either side."""
    start = None
    for k in range(n + 1):
        if k < n and free_i[p + k] and free_t[q + k]:
            start = k if start is None else start
        elif start is not None:
            if k - start >= least:
                yield start - k, p + start, q + start
            start = None


def greedy_tiles(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length): always the longest match that is
    left; of equal ones the first in the item, then in the text."""
    free_i, free_t = [True] * len(item), [True] * len(text)
    sums_i, sums_t = _prefix(item), _prefix(text)
    power = [1]
    for _ in range(max(len(item), len(text))):
        power.append(power[-1] * _RADIX & _MASK)

    def windows(sums, free, s):
        run = 0
        for k in range(len(free)):
            run = run + 1 if free[k] else 0
            if run >= s:
                yield k + 1 - s, (sums[k + 1] - sums[k + 1 - s] * power[s]) & _MASK

    tiles = []
    s = max(min_match, min(len(item), len(text)))
    while True:
        at: dict[int, list[int]] = {}
        for p, h in windows(sums_i, free_i, s):
            at.setdefault(h, []).append(p)
        found = []  # every whole match of at least s free tokens, once
        skip_to: dict[int, int] = {}
        for q, h in windows(sums_t, free_t, s) if at else ():
            for p in at.get(h, ()):
                if skip_to.get(p - q, -1) > q or item[p : p + s] != text[q : q + s]:
                    continue  # inside a match already found on this diagonal
                n = s
                while p + n < len(item) and q + n < len(text) and free_i[p + n] and free_t[q + n] and item[p + n] == text[q + n]:
                    n += 1
                skip_to[p - q] = q + n - s + 1
                found.append((-n, p, q))
        heapq.heapify(found)
        while found:
            n, p, q = heapq.heappop(found)
            parts = list(_free_parts(item, text, free_i, free_t, p, q, -n, s))
            if parts == [(n, p, q)]:
                free_i[p : p - n] = [False] * -n
                free_t[q : q - n] = [False] * -n
                tiles.append((p, q, -n))
            else:  # what is left of it waits for its length's turn
                for part in parts:
                    heapq.heappush(found, part)
        if s == min_match:
            return tiles
        s = max(min_match, s // 2)


def islands(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The tokens under the windows at ``starts`` (sorted); a 0 keeps stretches apart."""
    ends = starts + width
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    parts = []
    for k, lo in enumerate(new.tolist()):
        hi = new[k + 1] if k + 1 < len(new) else len(starts)
        if parts:
            parts.append(np.zeros(1, np.uint64))
        parts.append(words[starts[lo] : ends[hi - 1]])
    return np.concatenate(parts)


def _apart(text: list[int]) -> list[int]:
    """A token sequence whose breaks match nothing, not even each other's place in an item."""
    return [x if x else -1 - k for k, x in enumerate(text)]


def tile(item: list[int], text: list[int], min_match: int) -> tuple[int, int]:
    """(number of tiles, tokens covered)."""
    found = greedy_tiles(item, text, min_match)
    return len(found), sum(n for _, _, n in found)


class SeedIndex:
    """A few items and their seeds in memory: the same tiling, without Spark."""

    def __init__(self, ids: list, texts: list, min_match: int):
        self.min_match = min_match
        words, bounds = tokens(texts)
        self.items: list[tuple[int, list[int]]] = []
        seen: set[tuple] = set()
        seeds = []
        for i, a, b in sorted(zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), key=lambda x: x[0]):
            seq = tuple(words[a:b].tolist())
            if len(seq) >= min_match and seq not in seen:
                seen.add(seq)
                seeds.append(np.unique(chain(words[a:b], min_match)))
                self.items.append((i, list(seq)))
        self.seeds = seeds

    def verdicts(self, texts: list, threshold: float):
        """For each text: [(item id, tiles, covered, item tokens)] that reach the threshold, best first."""
        for t in texts:
            words, _ = tokens([t])
            windows = chain(words, self.min_match)
            hits = []
            for (i, seq), seeds in zip(self.items, self.seeds, strict=True):
                starts = np.flatnonzero(np.isin(windows, seeds))
                if len(starts):
                    tiles, covered = tile(seq, _apart(islands(words, starts, self.min_match).tolist()), self.min_match)
                    if covered >= threshold * len(seq):
                        hits.append((i, tiles, covered, len(seq)))
            yield sorted(hits, key=lambda x: (-x[2] / x[3], x[0]))


def _items(benchmark: DataFrame, item_col: str, text_col: str, min_match: int) -> DataFrame:
    """(key, item_id, seq): the distinct token sequences; key is a hash of the sequence."""
    source = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t <> ''")

    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_chunks(texts, BLOCK_TOKENS):
                words, bounds = tokens(texts[lo:hi])
                rows = [(i, words[a:b].tobytes()) for i, a, b in zip(ids[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a >= min_match]
                keys = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for _, x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["key", "item_id", "seq"])

    return source.mapInArrow(run, "key long, item_id long, seq binary").groupBy("key", "seq").agg(F.min("item_id").alias("item_id"))


def _seeds(items: DataFrame, min_match: int) -> DataFrame:
    """(key, seed, at): where the seeds of each item are."""

    def run(batches):
        for batch in slices(batches, 100):
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = chain(np.frombuffer(raw, np.uint64), min_match)
                for lo in range(0, len(own), 50_000):
                    part = own[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(part.view(np.int64)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32))], ["key", "seed", "at"])

    return items.select("key", "seq").mapInArrow(run, "key long, seed long, at int")


def _posted(items: DataFrame, seeds: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """(seed, key): each item's rarest seeds, so many that the rest can't cover ``threshold`` of it."""
    held = seeds.select("key", "seed").distinct().groupBy("seed").agg(F.count("*").alias("held"))
    ranked = seeds.join(held, "seed").select("key", F.struct("held", "seed", "at").alias("s")).groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("s"))
    ranked = ranked.join(items.select("key", (F.length("seq") / 8).cast("int").alias("n")), "key").select("key", "n", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))

    def run(batches):
        for batch in slices(batches, 100):
            for key, n, seed, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                # from the commonest on: leave out seeds while what they cover stays below the threshold
                covered, many, cut = np.zeros(n, bool), 0, len(seed)
                while cut:
                    lo = cut - 1
                    while lo and seed[lo - 1] == seed[cut - 1]:
                        lo -= 1
                    for x in at[lo:cut]:
                        many += min_match - int(covered[x : x + min_match].sum())
                        covered[x : x + min_match] = True
                    if many >= threshold * n:
                        break
                    cut = lo
                some = sorted(set(seed[:cut]))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([key] * len(some), pa.int64())], ["seed", "key"])

    return ranked.mapInArrow(run, "seed long, key long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which low ``BITMAP_BITS`` bits of a seed occur: 2**(BITMAP_BITS - 3) bytes, whatever the input."""
    place = F.col("seed").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = seeds.select(place.alias("p")).groupBy(F.shiftright("p", ROW_BITS).alias("row")).agg(F.expr(f"bitmap_construct_agg(p & {(1 << ROW_BITS) - 1})").alias("bits"))
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    size = 1 << (ROW_BITS - 3)
    for r in rows.collect():  # at most 2**(BITMAP_BITS - ROW_BITS) rows
        bits[r["row"] * size : (r["row"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _touched(docs: DataFrame, bits, min_match: int) -> DataFrame:
    """(id, th, islands, seeds) of the rows that hold a window the bitmap knows."""

    def run(batches):
        for batch in slices(batches):
            texts, at, text, found = batch.column(2).to_pylist(), [], [], []
            for lo, hi in text_chunks(texts):
                words, bounds = tokens(texts[lo:hi])
                windows = chain(words, min_match)
                hit = np.flatnonzero(_in(bits.value, windows))
                cut = np.searchsorted(hit, bounds)
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    own = hit[cut[k] : cut[k + 1]]
                    own = own[own + min_match <= bounds[k + 1]]
                    if len(own):
                        at.append(lo + k)
                        text.append(islands(words, own, min_match).tobytes())
                        found.append(np.unique(windows[own]).view(np.int64))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(text, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "th", "islands", "seeds"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, islands binary, seeds array<long>")


def _bounded(df: DataFrame, size) -> DataFrame:
    """A broadcast of what is small by its counted size, else the frame as it is."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def _verdicts(docs: DataFrame, benchmark: DataFrame, threshold: float, min_match: int, item_col: str, item_text_col: str) -> DataFrame:
    """A table (id, th, item_id, n_tiles, covered, item_tokens) of the pairs that reach the
    threshold, once for each distinct (id, hash of the text)."""
    spark = docs.sparkSession
    items = staged(_items(benchmark, item_col, item_text_col, min_match), "items")
    seeds = staged(_seeds(items, min_match), "seeds")
    posted = staged(_posted(items, seeds, min_match, threshold), "posted")
    bits = spark.sparkContext.broadcast(_bitmap(seeds))
    with small_batches(spark):
        touched = staged(_touched(docs, bits, min_match), "touched")
    # a row is a repeated one or a common passage's: the seed's rows are dealt to parts
    rows = touched.select("id", "th", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("seeds").alias("seed"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    pairs = rows.join(_bounded(posted.select("seed", "key", salts), F.lit(32)), ["seed", "salt"]).select("id", "th", "key", "salt").distinct()
    one = touched.select("id", "th", "islands").withColumn("n", F.length("islands")).groupBy("id", "th", "n").agg(F.first("islands").alias("islands")).drop("n")
    met = pairs.join(_bounded(items.select("key", "item_id", "seq", salts), 32 + F.length("seq")), ["key", "salt"]).drop("key", "salt").alias("p")
    one = one.alias("o")
    met = met.join(one, F.col("p.id").eqNullSafe(F.col("o.id")) & (F.col("p.th") == F.col("o.th"))).select("p.id", "p.th", "item_id", "seq", "islands")

    def run(batches):
        for batch in slices(batches):
            where, found = [], []
            for k, (seq, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                seq = np.frombuffer(seq, np.uint64).tolist()
                tiles, covered = tile(seq, _apart(np.frombuffer(text, np.uint64).tolist()), min_match)
                if covered >= threshold * len(seq):
                    where.append(k)
                    found.append((tiles, covered, len(seq)))
            rows = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(3)), *(pa.array([x[k] for x in found], pa.int32()) for k in range(3))], ["id", "th", "item_id", "n_tiles", "covered", "item_tokens"])

    return staged(met.mapInArrow(run, "id long, th long, item_id long, n_tiles int, covered int, item_tokens int"), "verdicts")


def _documents(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select((F.col(id_col).cast("long") if id_col else F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each contaminated document: (id, item_id of the best covered item,
    n_tiles, covered, item_tokens, coverage, and item_ids of all items that reach the
    threshold)."""
    docs = _documents(df, id_col, text_col)
    found = _verdicts(docs, benchmark, threshold, min_match, item_col, item_text_col)
    share = F.col("covered") / F.col("item_tokens")
    best = F.min(F.struct((-share).alias("less"), "item_id", "n_tiles", "covered", "item_tokens")).alias("b")
    found = found.groupBy("id", "th").agg(best, F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(F.col("id").alias("v_id"), F.col("th").alias("v_th"), "b", "item_ids")
    rows = docs.select("id", "th").join(found, F.col("id").eqNullSafe(F.col("v_id")) & (F.col("th") == F.col("v_th")))
    return rows.select(F.col("id").alias(id_col), *(F.col(f"b.{c}").alias(c) for c in ("item_id", "n_tiles", "covered", "item_tokens")), (-F.col("b.less")).alias("coverage"), "item_ids")


def keep_clean(df: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not contaminated, all columns as they are.  Texts move
    only where the contaminated ones are too many to broadcast their hashes."""
    found = _verdicts(_documents(df, None, text_col), benchmark, threshold, min_match, item_col, item_text_col)
    th = free_name(df, "__th")
    gone = found.select(F.col("th").alias(th)).distinct()
    return df.join(_bounded(gone, F.lit(24)), F.xxhash64(F.col(text_col).cast("string")) == F.col(th), "left_anti")
