"""Joins of intervals within files, by sweeps over sorted events.

Nodes and probes of all files are sorted together by file and start, over all partitions,
so a file of any size is spread over as many as its rows need.  What is still open where a
partition ends in the middle of a file is handed on to the partitions that it reaches into.
Each partition is then swept once, file by file: (n + m) log n steps, and as many rows as
there are results, instead of all pairs of a file.

Rows with a null key, start or end meet nothing.  Columns of any name are carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.sources.storage import shared_folder

_NODE, _PROBE = 0, 1


def _events(df: DataFrame, keys: list[str], kind: int, start: str, end: str, order: str | None, node, probe) -> DataFrame:
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in keys))
    null = lambda t: F.lit(None).cast(t)
    at = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    out = df.select(*at, F.lit(kind).alias("kind"), F.col(start).cast("long").alias("pos"), F.col(end).cast("long").alias("last"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("rank"), (row if kind == _NODE else null(node)).alias("node"), (row if kind == _PROBE else null(probe)).alias("probe"))
    return out.dropna(subset=[*(f"k{i}" for i in range(len(keys))), "pos", "last"])


def _placed(events: DataFrame, n_keys: int, both: bool) -> DataFrame:
    """Events with the part (partition) they are swept in, and those carried into later parts."""
    spark, ks = events.sparkSession, [f"k{i}" for i in range(n_keys)]
    path = shared_folder(spark, "events")
    events.repartitionByRange(*ks, "pos", "kind").withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    # a partition ends in one file at most, so no more rows than there are partitions have a next part
    parts = placed.groupBy(*ks, "part").agg(F.min("pos").alias("first"))
    files = Window.partitionBy(*ks)
    later = F.collect_list(F.struct(F.col("part").alias("part"), F.col("first").alias("first"))).over(files.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    cut = parts.withColumn("n", F.count("*").over(files)).where("n > 1").withColumn("later", later).where(F.size("later") > 0).select(*ks, "part", "later")
    some = placed if both else placed.where(F.col("kind") == _NODE)
    open_ = some.join(cut, [*ks, "part"]).where(F.col("last") >= F.col("later")[0]["first"])
    reached = open_.withColumn("part", F.explode(F.filter("later", lambda p: p["first"] <= F.col("last"))["part"]))
    return placed.withColumn("carried", F.lit(False)).unionByName(reached.drop("later").withColumn("carried", F.lit(True)))


def _smallest(kind: list, pos: list, last: list, rank: list, carried: list) -> tuple[list, list]:
    """Of each probe the shortest node around it; ends from the last on are a prefix of a tree
    of least places, into which nodes come as they begin."""
    nodes = [i for i, k in enumerate(kind) if k == _NODE]
    best = sorted(nodes, key=lambda i: (last[i] - pos[i], rank[i], i))
    place = dict(zip(best, range(len(best)), strict=True))
    ends = sorted({-last[i] for i in nodes})
    tree, none = [len(best)] * (len(ends) + 1), len(best)
    at_end = {-e: k + 1 for k, e in enumerate(ends)}
    probes, found = [], []
    where = np.searchsorted(ends, [-x for x in last], side="right").tolist() if ends else [0] * len(kind)
    for i, k in enumerate(kind):
        if k == _NODE:
            p, j = place[i], at_end[last[i]]
            while j < len(tree):
                if p < tree[j]:
                    tree[j] = p
                j += j & -j
        else:
            p, j = none, where[i]
            while j:
                if tree[j] < p:
                    p = tree[j]
                j -= j & -j
            if p < none:
                probes.append(i)
                found.append(best[p])
    return probes, found


def _meeting(kind: list, pos: list, last: list, rank: list, carried: list) -> tuple[list, list]:
    """All pairs of a node and a probe that meet; open ones are kept by their ends."""
    opened, pairs = ([], []), []
    for i, k in enumerate(kind):
        for heap in opened:
            while heap and heap[0][0] < pos[i]:
                heapq.heappop(heap)
        if not carried[i]:
            pairs += [(i, j) for _, j in opened[1 - k] if last[i] >= pos[j]]
        heapq.heappush(opened[k], (last[i], i))
    probes = [i if kind[i] == _PROBE else j for i, j in pairs]
    return probes, [j if kind[i] == _PROBE else i for i, j in pairs]


def _swept(nodes: DataFrame, probes: DataFrame, keys: list[str], span: tuple[str, str], probe: tuple[str, str], order: str | None, sweep: Callable, both: bool) -> DataFrame:
    """(keys, columns of probes, columns of nodes) of the pairs that ``sweep`` finds in a file."""
    of = lambda df: StructType([StructField(f.name, f.dataType) for f in df.schema if f.name not in keys])
    node_type, probe_type = of(nodes), of(probes)
    events = _events(nodes, keys, _NODE, *span, order, node_type, probe_type).unionByName(_events(probes, keys, _PROBE, *probe, None, node_type, probe_type))
    n, ks = len(keys), [f"k{i}" for i in range(len(keys))]
    placed = _placed(events, n, both).select("part", *ks, "pos", "kind", "last", "rank", "carried", "node", "probe")
    ordered = placed.repartition("part").sortWithinPartitions("part", *ks, "pos", "kind", "last", "rank")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            i, j = sweep(*(t.column(c).to_pylist() for c in ("kind", "pos", "last", "rank", "carried")))
            held.clear()
            if i:
                i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
                yield from pa.table([*(t.column(k).take(i) for k in ks), t.column("probe").take(i), t.column("node").take(j)], [*ks, "probe", "node"]).to_batches(10_000)

        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in range(n + 1)), strict=True))
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and tuple(held[-1].column(k)[0].as_py() for k in range(n + 1)) != own[lo]:
                    yield from close()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close()

    schema = StructType([*(StructField(k, placed.schema[k].dataType) for k in ks), StructField("probe", probe_type), StructField("node", node_type)])
    found = ordered.mapInArrow(run, schema)
    inner = lambda s, t: [F.col(s).getField(f.name).alias(f.name) for f in t]
    return found.select(*(F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)), *inner("probe", probe_type), *inner("node", node_type))


def smallest_enclosing(items: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each item (i_start, i_end) with the smallest node (start, end, ord) of its file that holds
    it; ties go to the least ord.  Items that no node holds are left out."""
    return _swept(nodes, items, keys, ("start", "end"), ("i_start", "i_end"), "ord", _smallest, False)


def meeting(ranges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Every range (r_start, r_end) with every node (start, end) of its file that it meets."""
    return _swept(nodes, ranges, keys, ("start", "end"), ("r_start", "r_end"), None, _meeting, True)


def touched(ranges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes (start, end) that some range (r_start, r_end) of their file meets, each once.

    A node is met if the furthest end of the ranges that begin up to its end reaches its
    start: a running maximum over sorted rows, with the maximum of the parts before."""
    probe = ranges.select(*keys, F.col("r_start").alias("i_start"), F.col("r_end").alias("i_end"))
    node_type = StructType([StructField(f.name, f.dataType) for f in nodes.schema if f.name not in keys])
    ks, spark = [f"k{i}" for i in range(len(keys))], ranges.sparkSession
    far = _events(probe, keys, 0, "i_start", "i_end", None, node_type, "int").withColumn("node", F.lit(None).cast(node_type))
    own = _events(nodes, keys, 0, "end", "start", None, node_type, "int").withColumn("kind", F.lit(1))
    events = far.unionByName(own).drop("rank", "probe")
    path = shared_folder(spark, "events")
    events.repartitionByRange(*ks, "pos", "kind").withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    reach = F.when(F.col("kind") == 0, F.col("last"))
    parts = placed.groupBy(*ks, "part").agg(F.max(reach).alias("top"), F.count("*").alias("n"))
    before = F.max("top").over(Window.partitionBy(*ks).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.withColumn("before", before).where("before is not null").select(*ks, "part", "before")
    running = F.max(reach).over(Window.partitionBy("part", *ks).orderBy("pos", "kind"))
    met = placed.withColumn("reach", running).where("kind = 1").join(carried, [*ks, "part"], "left").where(F.greatest("reach", "before") >= F.col("last"))
    return met.select(*(F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)), *(F.col("node").getField(f.name).alias(f.name) for f in node_type))
