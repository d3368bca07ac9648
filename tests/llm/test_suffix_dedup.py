"""Suffix dedup against dictionaries of all windows."""

import hashlib
import random

import numpy as np
import pytest

from corvane.llm import queries
from corvane.llm import suffix_dedup as sd


def brute(rows):
    """rows: (id, text) of distinct ids; (id, bytes, removed, spans, digest) in plain Python."""
    first, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in first:
                gone[p : p + 100] = True
            first.add(w)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, id int, at int, sub int, bytes int").repartition(5)
    return order(sd.suffix_dedup(df, **how).drop("kept").collect())


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def made(rng):
    shared = [words(rng, 60) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            parts += [s[a:b], words(rng, rng.randint(0, 3))]
        rows.append((i * 3 - 50, "".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "a" * 99), (1003, "a" * 100), (1004, "a" * 101), (1005, "ab" * 5000), (1006, "b" + "ab" * 300), (1007, "x" * 30_000), (1008, words(rng, 9) + "x" * 150), (2**62, rows[3][1]), (None, rows[4][1])]
    t = words(rng, 2000)
    return rows + [(2000, t), (2001, t[1:]), (2002, t[:4000] + "|" + t[4001:]), (2003, t + t)]


@pytest.mark.parametrize("hot", [4096, 2])
def test_equals_all_windows(spark, monkeypatch, hot):
    """With cold and hot anchors, texts in pieces, and runs settled in small lots."""
    monkeypatch.setattr(sd, "HOT", hot)
    for name, value in (("PIECE", 700), ("BLOCK", 3000), ("HELD", 200)):
        monkeypatch.setattr(sd, name, value)
    rows = made(random.Random(hot))
    assert found(spark, rows) == order(brute(rows))


def test_same_result_for_any_number_of_batches(spark):
    rows = made(random.Random(9))
    want = order(brute(rows))
    assert found(spark, rows, batches=1) == want
    assert found(spark, rows, batches=7) == want


def test_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b = words(rng, 80), words(rng, 80)
    got = found(spark, [(1, a), (1, a), (1, b), (None, a), (None, b + a), (2, b)])
    size = {t: len(t.encode()) for t in (a, b, b + a)}
    assert [r[1:3] for r in got if r[0] == 1] == sorted([(size[a], 0), (size[a], 0), (size[b], 0)])
    assert [r[1:3] for r in got if r[0] == 2] == [(size[b], size[b])]
    assert [r[2] for r in got if r[0] is None and r[1] == size[a]] == [size[a]]
    assert found(spark, []) == []


def test_texts_come_back(spark):
    a = words(random.Random(1), 100)
    df = spark.createDataFrame([(1, a), (2, "new " * 3 + a + " end")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in sd.suffix_dedup(df, texts=True).collect()}
    assert got == {1: a, 2: "new new new  end"}


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.queries()["op11_suffix_dedup"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert order(got) == order(brute([tuple(r) for r in table.select("doc_id", "text").collect()]))
