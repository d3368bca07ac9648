import random
import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from corvane.llm import filter_audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (id, part, text), labels: (id, quality, toxic); filters applied one by one."""
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, part, text in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (i is None or first[t] < i),
        }
        has = lambda k: any(x[k] == 1 for x in labels if x[0] == i and i is not None)
        rows.append((part or "", fails, has(1), has(2)))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(gone)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out.append([part, "".join(order), k, len(left), len(gone), redundant, only, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        for r in out:
            if r[0] == part:
                r[9] = shapley[r[9]]
    return sorted(map(tuple, out))


def audit(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, lang string, text string, id int, mask int, n int")
    lab = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, good int")
    return sorted(tuple(r) for r in filter_audit.filter_audit(d, lab).select(COLUMNS).collect())


def test_audit_equals_filters_applied_one_by_one(spark):
    rng = random.Random(2)
    long = " ".join(f"w{k}" for k in range(230))
    texts = [None, "", " ", "a b", "A B", "x # y", long, long + "\x0b", " " + long, "\t" + long + " A" * 30, "w " * 250, "W " * 250, "é\xa0ü" * 300, long + " $", "same text", "\n\n", "ÄÖ" * 10]
    docs = [(rng.choice([None, 2**62, -4, *range(20)]), rng.choice(["en", "de", "", None]), rng.choice(texts)) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(15)] + [(3, 1, 1), (None, 1, 1)]
    assert audit(spark, docs, labels) == brute(docs, labels)
    assert audit(spark, [], labels) == []
    assert len(audit(spark, docs[:1], [])) == 600


def test_whole_table_equals_its_sql(spark, sf_dir):
    got = queries.queries()["op13_filter_audit"](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({queries.oracle_sql()['op13_filter_audit']})").fetchall()
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == sorted(want)
    assert not [n for n in ("PythonUDF", "ArrowEvalPython", "MapInArrow") if n in got._jdf.queryExecution().toString()]


def test_shapley_shares_add_up(spark, sf_dir):
    got = queries.queries()["op13_filter_audit"](spark, sf_dir).groupBy("part", "filter_order").agg(F.sum("removed").alias("r"), F.sum("shapley").alias("s"))
    assert got.where("r * 120 <> s").count() == 0
