"""Conversation repair against a search that keeps whole audit strings."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from corvane.llm import conversation_repair as cr
from corvane.llm import queries

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """rows: (role, text, must go, truncated); (cost, audit, repaired turns) by whole strings."""
    names = {"u": "user", "a": "assistant"}

    # all audits of a state that cost least are kept for few rows, the least one for many
    layers = {0: [(0, "", [])]}
    for role, text, gone, late in rows:
        new = {}
        for q, some in layers.items():
            for cost, audit, said in some:
                ways = [(cost, audit, said, q)]
                for _ in range(2):
                    c, a, s, at = ways[-1]
                    r, to = next((r, to) for r, to in NEXT[at].items() if r in names)
                    ways.append((c + 2, a + "I", [*s, (names[r], "")], to))
                for c, a, s, at in ways:
                    new.setdefault(at, []).append((c + 3, a + "D", s))
                    if not gone:
                        if role[:1] in NEXT[at]:
                            new.setdefault(NEXT[at][role[:1]], []).append((c + late, a + "K", [*s, (role, text)]))
                        for r, to in NEXT[at].items():
                            if r in names:
                                new.setdefault(to, []).append((c + 2 + late, a + "R", [*s, (names[r], text)]))
        layers = {q: [x for x in some if x[0] == min(y[0] for y in some)] if len(rows) <= 8 else [min(some, key=lambda x: x[:2])] for q, some in new.items()}
    ends = []
    for state, some in layers.items():
        for cost, audit, said in some:
            q = state
            while q not in (0, 3):
                r, q = next((r, to) for r, to in NEXT[q].items() if r in names)
                cost, audit, said = cost + 2, audit + "I", [*said, (names[r], "")]
            ends.append((cost, audit, said))
    return min(ends, key=lambda x: x[:2])


def brute(rows):
    """What repaired() returns, from (conv_id, turn, role, text), in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, said = cheapest(kinds)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, conv int, step int, digest int")
    return order(cr.repaired(df).collect())


def test_steps_equal_whole_strings():
    rng = random.Random(7)
    for _ in range(300):
        kinds = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 8)))
        rows = [(k.lower() if k != "x" else "u", "t", k == "x", k.isupper()) for k in kinds]
        places, cost, tail = cr.joined([cr.table(kinds)])
        audit = "".join(cr.codes(kinds, *places[0])) + "I" * tail
        assert (cost, audit) == cheapest(rows)[:2]
        cut = sorted(rng.randint(0, len(kinds)) for _ in range(3))
        parts = [kinds[a:b] for a, b in zip([0, *cut], [*cut, len(kinds)], strict=True)]
        places, cost, tail = cr.joined([cr.table(p) for p in parts])
        assert (cost, "".join(c for p, at in zip(parts, places, strict=True) for c in cr.codes(p, *at)) + "I" * tail) == cheapest(rows)[:2]


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert order(cr.repaired(table).collect()) == order(brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf_dir}/conversations.parquet')")
    cur = con.execute(queries.oracle_sql()["op12_conversation_repair"])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    assert order(queries.queries()["op12_conversation_repair"](spark, sf_dir).select(names).collect()) == order(want)


def test_edges(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No", "a b?", "x" * 50_000 + ".", "\xa0", "é!\n", "same.", "same."])
    rows = [(rng.choice([None, 1, 2, 3, -5, 2**62]), rng.choice([None, -3, 0, 1, 2, 2, 7, 40]), rng.choice([None, "", "user", "assistant", "system", "User", "sage", "tool"]), text()) for _ in range(250)]
    assert repaired(spark, rows) == order(brute(rows))
    assert repaired(spark, rows[:0]) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "x")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_one_conversation_of_most_rows(spark, monkeypatch, chunk):
    """Split over chunks and partitions, with a row that occurs more often than a chunk has room."""
    monkeypatch.setattr(cr, "CHUNK", chunk)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", f"t{t}.", ""])) for t in range(600)] + [(1, 5, "user", "often")] * 70 + [(c, 0, "user", "hi") for c in range(2, 30)]
    assert repaired(spark, rows) == order(brute(rows))
