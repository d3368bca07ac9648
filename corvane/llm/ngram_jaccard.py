"""Set-similarity join on word shingles: rare-first prefix, length, positional and
suffix filters; links and components without emitting all pairs of a group.

1. Every text becomes its set of shingle hashes; equal sets become one class
   (a 64-bit signature, checked against one of other word hashes; where two sets share
   a signature all is hashed anew).  The same pass counts shingles over all documents
   in a hashed table of fixed size.
2. Rare-first order: shingles by (counter, hash).  Counter collisions can make a
   shingle look commoner than it is, which costs time but loses nothing, since any
   order that all sets share is a valid prefix order.
3. Each class posts its prefix n-grams.  A posting list is not expanded into pairs:
   each member is paired with the list's leader, the member with the fewest rarer
   shingles.  Lists of very common shingles are split by a salt, and the leaders of
   the splits are paired with the leader of all.
4. Each distinct pair is verified once against both whole sets (a suffix filter,
   then the exact intersection).
5. Links give components.  Lists that still hold several components give the pairs
   between them (length, positional and parity filters) that were not verified before; those
   are verified too, and the components joined.  Lists of over ``HOT_LIST`` members are
   cut by set size and salted for that.  Thus every link between different
   components is found; links inside a component need no proof.

A row is found again by its id and the hash of its text, so rows of a null or repeated
id take part like all others.

Defined results: null or empty texts, and texts of blanks only, have an empty set,
0 shingles, and are linked with nothing; fewer words than ``width`` make one shingle
of all words; rows that share an id share nothing but the id; a row with a null id
links like any other and takes the smallest id of its component (null if no row of it
has an id); an empty table gives an empty table; extra columns are not carried by
``ngram_jaccard`` and are kept by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._components import connected_components
from corvane.llm._shared import free_name, slices, small_batches, staged, text_chunks
from corvane.llm._words import shingle_sets

#: The counter table: 2**COUNTER_BITS counters, whatever the size of the input.
COUNTER_BITS = 22
BLOCK_BITS = 14
#: A shingle whose counter passes this share of all documents has its list split.
HOT_SHARE, SPLITS = 0.01, 32
#: A leader's members are verified in lots of this size.
LOT = 400
#: Routes of one row: a leader of more lots has several rows.
ROUTES = 1000
#: A side of a join is broadcast up to so many bytes by count; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Lists of more members are cut into cells before members of different components are paired.
HOT_LIST = 20_000
SALTS = 16
#: Sets go to their lots in batches of about so many bytes.
SENT_BYTES = 4 << 20


def _level(counts: np.ndarray) -> np.ndarray:
    """Counter to one byte, eight steps a doubling."""
    return np.minimum(255, np.floor(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _sets(texts: list, width: int, seed: int):
    for lo, hi in text_chunks(texts):
        yield from shingle_sets(texts[lo:hi], width, seed)


def _signature(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return tuple(np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw)], np.uint64).view(np.int64).tolist())


#: Added to the seed for the words of the second signature.
OTHER = 1000
#: Columns of a set's parities: bit k is the parity of its hashes that end in k (of 256).
PARITY = ("p0", "p1", "p2", "p3")


def _parity(s: np.ndarray) -> np.ndarray:
    """256 parities; where two sets' parities differ, the sets differ at least once each."""
    return np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)


def _first_pass(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Rows of documents (id, th, n, sid, check) and rows of counters (part, block, counts)."""
    names = ["id", "th", "n", "sid", "check", *PARITY, "part", "block", "counts"]

    def run(batches):
        held: list[np.ndarray] = []
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)

        def flush():
            if held:
                at, k = np.unique(np.concatenate(held), return_counts=True)
                counters[at] += k.astype(np.uint32)
                held.clear()

        none = lambda n, t: pa.nulls(n, t)
        size = 0
        for batch in slices(batches):
            n, sid, check, parity = [], [], [], []
            texts = batch.column(2).to_pylist()
            for s, other in zip(_sets(texts, width, seed), _sets(texts, width, seed + OTHER), strict=True):
                n.append(len(s))
                sid.append(_signature(s)[0])
                check.append(_signature(other)[1])
                parity.append(_parity(s))
                held.append((s >> np.uint64(64 - COUNTER_BITS)).astype(np.uint32))
                size += len(s)
                if size > 1 << 20:
                    flush()
                    size = 0
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(check, pa.int64()), *(pa.array(x) for x in np.array(parity, np.int64).reshape(-1, 4).T.copy()), none(k, pa.int64()), none(k, pa.int32()), none(k, pa.binary())], names)
        flush()
        part, pack = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        blocks, packed = [], []
        for b in range(1 << (COUNTER_BITS - BLOCK_BITS)):
            own = counters[b << BLOCK_BITS : (b + 1) << BLOCK_BITS]
            if own.any():
                blocks.append(b)
                packed.append(pack.compress(own.tobytes()))
        k = len(blocks)
        if k:
            yield pa.RecordBatch.from_arrays([*(none(k, pa.int64()) for _ in range(5 + len(PARITY))), pa.array([part] * k, pa.int64()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.select("id", "th", "text").mapInArrow(run, f"id long, th long, n long, sid long, check long, {', '.join(f'{p} long' for p in PARITY)}, part long, block int, counts binary")


def _sum_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
        packed = zstandard.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table({"lot": table.column("lot")[:1], "block": table.column("block")[:1], "counts": pa.array([packed], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(add, "lot long, block int, counts binary")


def _counter_table(rows: DataFrame) -> np.ndarray:
    """Levels of all counters: 2**COUNTER_BITS bytes on the driver, at any input size."""
    rows = rows.where("block is not null")
    top = rows.agg(F.max("part")).first()[0] or 0
    lots = int(top**0.5) + 1  # sums of sums: no task gets more than about a root of the parts
    sums = _sum_counters(rows.select((F.col("part") % lots).alias("lot"), "block", "counts"), ["lot", "block"])
    sums = _sum_counters(sums.withColumn("lot", F.lit(0).cast("long")), ["block"])

    def level(batches):
        for batch in batches:
            packed = [_level(np.frombuffer(zstandard.decompress(x), np.uint32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["block", "levels"])

    table = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in sums.select("block", "counts").mapInArrow(level, "block int, levels binary").collect():
        table[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["levels"], np.uint8)
    return table


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def _postings(docs: DataFrame, table, hot_level: int, width: int, seed: int, percent: int) -> DataFrame:
    """(k, sid, packed): each class's prefix n-grams, rarest first.  k is the n-gram's
    hash, for hot n-grams moved by the salt of the class; packed holds whether it is
    hot, the position and the set's size (30 bits each): three longs a posting."""

    def run(batches):
        levels = table.value
        seen: set[int] = set()
        for batch in slices(batches):
            hs, sids, ns, poss, hots = [], [], [], [], []
            for s in _sets(batch.column(0).to_pylist(), width, seed):
                n = len(s)
                sid = _signature(s)[0]
                if not n or sid in seen:
                    continue
                if len(seen) < 1 << 20:  # only spares postings that would be equal
                    seen.add(sid)
                p = n - _need(n, percent) + 1
                level = levels[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:p]
                hs.append(s[order])
                hots.append(level[order] >= hot_level)
                sids.append(np.full(p, sid, np.int64))
                ns.append(np.full(p, n, np.int64))
                poss.append(np.arange(p, dtype=np.int64))
            if not hs:
                continue
            sid = np.concatenate(sids)
            hot = np.concatenate(hots)
            key = np.concatenate(hs).view(np.int64) ^ np.where(hot, (sid & (SPLITS - 1)) + 1, 0)
            packed = (hot.astype(np.int64) << 60) | (np.concatenate(poss) << 30) | np.concatenate(ns)
            out = pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid), pa.array(packed)], ["k", "sid", "packed"])
            for lo in range(0, out.num_rows, 50_000):
                yield out.slice(lo, 50_000)

    return docs.select("text").mapInArrow(run, "k long, sid long, packed long")


def _bounds(a_n: str, a_pos: str, b_n: str, b_pos: str, percent: int):
    """Length filter, and positional filter (true for the first common prefix n-gram
    of every similar pair): 1 + the smaller rest must reach the overlap asked for."""
    return F.expr(
        f"100 * least({a_n}, {b_n}) >= {percent} * greatest({a_n}, {b_n}) "
        f"and {100 + percent}L * least({a_n} - {a_pos}, {b_n} - {b_pos}) >= {percent}L * ({a_n} + {b_n})"
    )


def _suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Upper bound of the overlap: halves around a probe can't match across it."""
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    probe = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, probe))
    return _suffix_bound(a[:i], b[:j], depth - 1) + _suffix_bound(a[i:], b[j:], depth - 1)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    asked = percent * (len(a) + len(b))
    if (100 + percent) * _suffix_bound(a, b) < asked:
        return False
    both = np.concatenate([a, b])
    both.sort()
    return (100 + percent) * int(np.count_nonzero(both[1:] == both[:-1])) >= asked


def _small(df: DataFrame, size) -> bool:
    """Whether the rows of ``df``, of ``size`` bytes each, are few enough to broadcast."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _sent(columns: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "lot", "kind", "b", "items"])


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, seed: int, percent: int) -> DataFrame:
    """The linked ones of the distinct pairs (a, b).  Only sets that occur in a pair
    are made again from their texts; a leader's set is sent once per lot of members."""
    many = pairs.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > LOT)
    pairs = staged(pairs.join(many, "a", "left").select("a", "b", F.expr(f"cast(coalesce(ceil(k / {LOT}), 1) as int)").alias("lots")), "pairs")
    pairs = pairs.withColumn("lot", F.expr("cast(pmod(b, lots) as int)"))
    route = lambda kind: F.struct("a", "lot", F.lit(kind).alias("kind"))
    # a member has a route for each list of its prefix at most; a leader's are cut into rows
    members = pairs.select(F.col("b").alias("sid"), F.lit(0).alias("chunk"), route(1).alias("route"))
    leaders = pairs.select("a", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot")).distinct().select(F.col("a").alias("sid"), F.expr(f"lot div {ROUTES}").cast("int").alias("chunk"), route(0).alias("route"))
    routes = members.union(leaders).groupBy("sid", "chunk").agg(F.collect_list("route").alias("routes"))
    routes = staged(classes.select("sid", F.col("rep.id").alias("r_id"), F.col("rep.th").alias("r_th")).join(routes, "sid"), "routes")
    wanted = F.broadcast(routes) if _small(routes, 100 + 40 * F.size("routes")) else routes.hint("shuffle_hash")

    def sets(batches):
        done: set[tuple[int, int]] = set()  # spares what repeated rows would send again
        for batch in slices(batches, 500):
            texts, sids, chunks, ways = (batch.column(k).to_pylist() for k in range(4))
            new = [k for k, x in enumerate(zip(sids, chunks, strict=True)) if x not in done]
            out: list[list] = [[], [], [], [], []]
            size = 0
            for s, k in zip(_sets([texts[k] for k in new], width, seed), new, strict=True):
                if (sids[k], chunks[k]) in done or _signature(s)[0] != sids[k]:
                    continue
                if len(done) < 1 << 20:
                    done.add((sids[k], chunks[k]))
                raw = s.tobytes()
                for w in ways[k]:
                    for col, x in zip(out, (w["a"], w["lot"], w["kind"], sids[k], raw), strict=True):
                        col.append(x)
                    size += len(raw) + 32
                    if size > SENT_BYTES:
                        yield _sent(out)
                        out, size = [[], [], [], [], []], 0
            yield _sent(out)

    # every set goes straight from its text to the lots it is compared in: one shuffle
    found = docs.join(wanted, (F.col("th") == F.col("r_th")) & F.col("id").eqNullSafe(F.col("r_id")))
    sent = found.select("text", "sid", "chunk", "routes").mapInArrow(sets, "a long, lot int, kind int, b long, items binary")
    lots = sent.repartition("a", "lot").sortWithinPartitions("a", "lot", "kind", "b")

    def check(batches):
        of, leader = None, None
        for batch in slices(batches):
            a_out, b_out = [], []
            for a, lot, kind, b, items in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = np.frombuffer(items, np.uint64)
                if kind == 0:
                    of, leader = (a, lot), own
                elif of == (a, lot) and _linked(leader, own, percent):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return staged(lots.mapInArrow(check, "a long, b long").distinct(), "links")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _with_classes(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """Rows with what their classes are named; a class may hold most rows, so both are salted."""
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.drop(*PARITY, "check").withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.lit(SALTS)).cast("int")).join(salted, ["sid", "salt"], how)


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): two documents are linked when the Jaccard
    similarity of their shingle sets is at least ``percent`` / 100; component_id is
    the smallest id reachable over links."""
    with small_batches(df.sparkSession):
        rows, named = _components(_documents(df, id_col, text_col), width, percent)
    out = _with_classes(rows, named, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.expr("if(n > 0, coalesce(keep.id, id), id)").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns as they are: the row of the smallest id
    (rows without an id come last; of one id the text of the smaller hash).  Rows with
    nothing to compare stay; a row that is given twice, id and text, stays once."""
    with small_batches(df.sparkSession):
        rows, named = _components(_documents(df, id_col, text_col), width, percent)
    own_id, own_th = free_name(df, "__id"), free_name(df, "__th")
    mine = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("th") == F.col("keep.th"))
    lost = staged(_with_classes(rows.where("n > 0"), named, "inner").where(~mine).select(F.col("id").alias(own_id), F.col("th").alias(own_th)).distinct(), "lost")
    small = F.broadcast(lost) if _small(lost, F.lit(32)) else lost.hint("shuffle_hash")
    text = F.col(text_col).cast("string")
    gone = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_th))
    out = df.join(small, gone, "left_anti")
    if rows.groupBy("id", "th").count().where("count > 1").limit(1).count():
        out = out.withColumn(own_th, F.xxhash64(text)).dropDuplicates([id_col, own_th]).select(*(F.col(f"`{c}`") for c in df.columns))
    return out


def _components(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, sid, ...) of documents, and (sid, keep) of the classes that several rows
    or several classes share, keep being the first row of the component; both are tables."""
    spark = docs.sparkSession
    for seed in range(1, 9):
        first = staged(_first_pass(docs, width, seed), "first_pass")
        rows = first.where("n is not null").select("id", "th", "n", "sid", "check", *PARITY)
        address = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
        classes = staged(rows.where("n > 0").groupBy("sid").agg(address.alias("rep"), F.count("*").alias("k"), F.min("check").alias("c0"), F.max("check").alias("c1"), *(F.min(p).alias(p) for p in PARITY)), "classes")
        if classes.where("c0 <> c1").limit(1).count() == 0:
            break  # no two different sets share a signature
    levels = _counter_table(first)
    n_docs = rows.count()
    hot_level = int(_level(np.array([max(1000, HOT_SHARE * n_docs)]))[0])
    table = spark.sparkContext.broadcast(levels)

    posted = _postings(docs, table, hot_level, width, seed, percent)
    # packed sorts by (hot, position, size), so the first of a list has the fewest rarer n-grams
    in_list = Window.partitionBy("k").orderBy("packed", "sid").rowsBetween(Window.unboundedPreceding, 0)
    lists = posted.withColumn("l_sid", F.first("sid").over(in_list)).withColumn("l_packed", F.first("packed").over(in_list))
    hot = "packed >= (1L << 60)"
    low30 = (1 << 30) - 1
    lists = lists.select(
        F.expr(f"k ^ if({hot}, (sid & {SPLITS - 1}) + 1, 0L)").alias("h"), F.expr(f"if({hot}, (sid & {SPLITS - 1}) + 1, 0L)").alias("salt"), "sid", "l_sid",
        *(F.expr(f"cast(({p}packed >> {b}) & {low30} as int)").alias(f"{p}{c}") for p in ("", "l_") for c, b in (("n", 0), ("pos", 30))),
    )
    # a list's only member has no partner; the only member of one split may have
    lists = staged(lists.where("sid <> l_sid or salt > 0"), "lists")

    in_hot = Window.partitionBy("h").orderBy("l_pos", "l_sid").rowsBetween(Window.unboundedPreceding, 0)
    splits = lists.where("salt > 0").select("h", "l_sid", "l_n", "l_pos").distinct().withColumn("top", F.first(F.struct("l_sid", "l_n", "l_pos")).over(in_hot))
    splits = splits.select(F.col("l_sid").alias("sid"), F.col("l_n").alias("n"), F.col("l_pos").alias("pos"), F.col("top.l_sid").alias("l_sid"), F.col("top.l_n").alias("l_n"), F.col("top.l_pos").alias("l_pos"))
    star = lists.select("sid", "n", "pos", "l_sid", "l_n", "l_pos").unionByName(splits).where("sid <> l_sid").where(_bounds("n", "pos", "l_n", "l_pos", percent))
    star = staged(star.select(F.col("l_sid").alias("a"), F.col("sid").alias("b")).distinct(), "star")
    links = _verify(star, docs, classes, width, seed, percent)
    comp = connected_components(links, "a", "b")

    # pairs between different components that share a list and were not verified
    members = lists.select("h", "sid", "n", "pos").union(lists.select("h", "l_sid", "l_n", "l_pos")).distinct()
    members = members.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    members = staged(members, "members")
    mixed = members.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).where("lo < hi").select("h", "held")
    members = members.join(mixed, "h").join(classes.select("sid", *PARITY), "sid")
    members = staged(members, "mixed")
    # a list of many members is cut: by size, since similar sets are of similar size (at most
    # one step apart), and one side by salts, which the other side visits all
    step = max(np.log(100 / percent), 0.01) * 1.000001
    hot = f"held > {HOT_LIST}"
    members = members.withColumn("cells", F.expr(f"cast(ceil(held / {HOT_LIST}) as int)")).withColumn("step", F.expr(f"if({hot}, cast(floor(ln(n) / {step}) as int), 0)"))
    columns = ("sid", "n", "pos", "comp", *PARITY)
    a = members.select("h", "step", F.expr("cast(pmod(xxhash64(sid), cells) as int)").alias("cell"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = members.withColumn("step", F.explode(F.expr(f"if({hot}, array(step - 1, step, step + 1), array(0))"))).withColumn("cell", F.explode(F.expr("sequence(0, cells - 1)")))
    b = b.select("h", "step", "cell", *(F.col(c).alias(f"b_{c}") for c in columns))
    # the suffix filter without the sets: parities that differ bound the difference
    apart = " + ".join(f"bit_count(a_{p} ^ b_{p})" for p in PARITY)
    suffix = F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * (a_n + b_n)")
    across = a.join(b, ["h", "step", "cell"]).where((F.col("a_comp") < F.col("b_comp")) & _bounds("a_n", "a_pos", "b_n", "b_pos", percent) & suffix).select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct()
    done = star.union(star.select(F.col("b"), F.col("a")))
    across = staged(across.join(done, ["a", "b"], "left_anti"), "across")
    if across.limit(1).count():
        links = links.union(_verify(across, docs, classes, width, seed, percent))
        comp = connected_components(links, "a", "b")

    # only classes of several documents or on a link need a component of their own
    named = classes.join(comp.withColumnRenamed("node", "sid"), "sid", "left").where("k > 1 or comp is not null").select("sid", F.coalesce("comp", "sid").alias("comp"), "rep")
    least = named.groupBy("comp").agg(F.min("rep").alias("keep"))
    named = staged(named.join(least, "comp").select("sid", "keep"), "named")
    return rows, named
