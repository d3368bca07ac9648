"""Interval joins against all pairs."""

import random

import pytest

from corvane.operators import intervals, relational


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables keep their partitions, so files are cut."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def brute(items, nodes):
    out = []
    for f, item, a, b in items:
        best = min(((e - s, o, n) for g, o, s, e, n in nodes if f == g and None not in (f, a, b, s, e) and s <= a and e >= b), default=None)
        if best:
            out.append((f, item, best[2]))
    return sorted(out)


def frames(spark, items, nodes):
    return spark.createDataFrame(items, "f string, item int, i_start int, i_end int"), spark.createDataFrame(nodes, "f string, ord int, start int, end int, name string")


def made(rng, n, laminar):
    nodes, items = [], []
    for k in range(n):
        f = rng.choice(["big"] * 8 + ["a", "b", None])
        size = 2 ** rng.randint(0, 9)
        at = rng.randint(0, 1000) // size * size if laminar else rng.randint(0, 1000)
        nodes.append((f, k, at, at + size - 1 if rng.random() > 0.02 else None, f"n{k % 50}"))
        a = rng.randint(0, 1000)
        items.append((rng.choice(["big"] * 8 + ["a", None, "none"]), k, a, a + rng.choice([0, 0, 1, 7, -1])))
    return items, nodes


@pytest.mark.parametrize("laminar", [True, False])
def test_smallest_enclosing(spark, laminar):
    items, nodes = made(random.Random(laminar), 400, laminar)
    got = relational.enclosing(*frames(spark, items, nodes), ["f"], ["item"]).select("f", "item", "name").collect()
    assert sorted(map(tuple, got)) == brute(items, nodes)


@pytest.mark.parametrize("laminar", [True, False])
def test_meeting_and_touched(spark, laminar):
    items, nodes = made(random.Random(5 + laminar), 300, laminar)
    i, n = frames(spark, items, nodes)
    ranges = i.withColumnsRenamed({"i_start": "r_start", "i_end": "r_end"})
    pairs = [(f, item, name, o) for f, item, a, b in items for g, o, s, e, name in nodes if f == g and None not in (f, e) and not (b < s or a > e)]
    got = intervals.meeting(ranges, n, ["f"]).select("f", "item", "name", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(pairs)
    got = intervals.touched(ranges, n, ["f"]).select("f", "ord").collect()
    assert sorted(map(tuple, got)) == sorted({(p[0], p[3]) for p in pairs})
    assert {tuple(r) for r in relational.overlapping(ranges, n, ["f"]).collect()} == {(p[0], p[2]) for p in pairs}


def test_empty_tables(spark):
    i, n = frames(spark, [], [])
    assert relational.enclosing(i, n, ["f"], ["item"]).collect() == [] == intervals.touched(i.withColumnsRenamed({"i_start": "r_start", "i_end": "r_end"}), n, ["f"]).collect()


def test_one_file_of_many_nodes(spark):
    """20,000 items and 20,000 nodes of one file, in several partitions; no plan makes their pairs."""
    n = 20_000
    items = spark.range(n).selectExpr("'x' f", "cast(id as int) item", "cast(id as int) i_start", "cast(id as int) i_end")
    nodes = spark.range(n).selectExpr("'x' f", "cast(id as int) ord", "cast(id div 8 * 8 as int) start", "cast(id div 8 * 8 + pow(2, 3 + id % 8) - 1 as int) end", "cast(id as string) name").unionByName(spark.sql("select 'x' f, -1 ord, 0 start, 1000000 end, 'all' name"))
    found = relational.enclosing(items, nodes, ["f"], ["item"])
    got = {r["item"]: r["name"] for r in found.collect()}
    assert len(got) == n
    rows = [(r["start"], r["end"], r["ord"], r["name"]) for r in nodes.collect()]
    by_start = {}
    for s, e, o, name in rows:
        by_start.setdefault(s, []).append((s, e, o, name))
    for item in random.Random(1).sample(range(n), 300):
        near = [x for s in range(max(0, item - 1100) // 8 * 8, item + 1, 8) for x in by_start.get(s, ())] + by_start[0]
        want = min((e - s, o, name) for s, e, o, name in near if s <= item <= e)
        assert got[item] == want[2]
    ranges = items.where("item % 100 = 0").selectExpr("f", "item r_start", "item r_end")
    assert relational.touched_names(ranges, nodes, ["f"]).count() == 1
