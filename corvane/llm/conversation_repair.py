"""Conversation structure repair by a rank-compressed dynamic program.

A conversation's rows, by turn, are brought into the roles ``(s?(ua)+)?`` at least cost:
Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank and repeated
rows), Insert an empty user or assistant turn 2; a truncated row that stays adds 1.  Of
edits that cost the same, those of the least audit string (their initials) are taken.

*Macro edits.*  Every row ends one macro edit, the turns inserted before it and what is
done with it: the codes D, ID, IID, IIK, IIR, IK, IR, K and R are prefix-free, so audit
strings of as many rows differ before either ends and keep their order whatever follows.
A layer of the program therefore holds, for each of four states, the least cost and the
*rank* of its audit string among the states, instead of the string.  Costs taken less the
least one, few layers exist, so steps are looked up.  Strings are put together afterwards
by parent pointers.

*Chunks.*  Rows are sorted over all partitions by conversation and turn and cut into
chunks of ``CHUNK`` rows.  A chunk is a table of costs, ranks and ends for each state it
may begin in; these tables (not rows) are combined conversation by conversation, which
fixes where each chunk begins and ends, and chunks are then solved apart.  A conversation
that holds a third of all rows is thus spread like any other.  Only the digest of its
repaired text, which SHA-256 takes in order, is made in one task, as a stream of rows
that is never held; texts are shuffled once, for it.

Defined results: a null id or turn stands as one space in the damage key and comes first
in order; a null role or text is one space; rows of one turn stand in the order of role
and text digest; equal rows are counted and come one after another; an initial other than
s, u, a fits nowhere; all conversations get a row, those without rows left with zeros, no
edits and the digest of nothing; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import small_batches, staged

CHUNK = 1024
#: States: nothing said yet, after system, after user, after assistant.
_INSERTED = (2, 2, 3, 2)
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NAMES = {2: "user", 3: "assistant"}
_ENDS = {0: 0, 3: 0, 2: 1, 1: 2}  # turns to insert after the last row
_CODES = sorted("I" * n + e for n in range(3) for e in "DKR")
_CODE_RANK = {c: k for k, c in enumerate(_CODES)}
GONE = "x"  # the class of rows that must be deleted; others: the initial, in upper case if truncated


def _ranked(best: dict) -> tuple:
    """The layer of {state: (cost, place)}: costs less the least, dense ranks of the places."""
    if not best:
        return (None,) * 4, 0
    least = min(c for c, _ in best.values())
    order = {p: k for k, p in enumerate(sorted(p for _, p in best.values()))}
    return tuple((best[q][0] - least, order[best[q][1]]) if q in best else None for q in range(4)), least


@lru_cache(maxsize=1 << 16)
def _step(layer: tuple, kind: str) -> tuple:
    """(next layer, cost added, parents): parents[state] = (state before, code)."""
    best, parents, late, initial = {}, {}, int(kind.isupper()), kind.lower()
    for q, entry in enumerate(layer):
        if entry is None:
            continue
        at = q
        for n in range(3):
            ways = [("D", at, 3)]
            if kind != GONE:
                ways.append(("R", _INSERTED[at], 2 + late))
                if (at, initial) in _KEPT:
                    ways.append(("K", _KEPT[at, initial], late))
            for edit, to, cost in ways:
                code = "I" * n + edit
                found = (entry[0] + 2 * n + cost, (entry[1], _CODE_RANK[code]))
                if to not in best or found < best[to]:
                    best[to], parents[to] = found, (q, code)
            at = _INSERTED[at]
    return *_ranked(best), parents


def _from(q: int) -> tuple:
    return tuple((0, 0) if k == q else None for k in range(4))


def solved(kinds: str, start: int) -> tuple[list, list[tuple]]:
    """Layers' parents and the last layer as [(state, cost, rank)] of rows' classes."""
    layer, cost, parents = _from(start), 0, []
    for kind in kinds:
        layer, more, before = _step(layer, kind)
        cost += more
        parents.append(before)
    return parents, [(q, cost + e[0], e[1]) for q, e in enumerate(layer) if e]


def table(kinds: str) -> list[int]:
    """Cost and rank of each end state from each start state, -1 where there is none."""
    out = [-1] * 32
    for q in range(4):
        for to, cost, rank in solved(kinds, q)[1]:
            out[8 * q + 2 * to : 8 * q + 2 * to + 2] = cost, rank
    return out


def joined(tables: list[list[int]]) -> tuple[list[tuple[int, int]], int, int]:
    """(start and end state of each chunk, cost, turns inserted at the end)."""
    layer, cost, parents = _from(0), 0, []
    for t in tables:
        best, before = {}, {}
        for q, entry in enumerate(layer):
            for to in range(4) if entry else ():
                c, r = t[8 * q + 2 * to : 8 * q + 2 * to + 2]
                if c >= 0:
                    found = (entry[0] + c, (entry[1], r))
                    if to not in best or found < best[to]:
                        best[to], before[to] = found, q
        layer, more = _ranked(best)
        cost += more
        parents.append(before)
    least, _, end = min((e[0] + 2 * _ENDS[q], e[1], q) for q, e in enumerate(layer) if e)
    tail, places = _ENDS[end], []
    for before in reversed(parents):
        places.append((before[end], end))
        end = before[end]
    return places[::-1], cost + least, tail


def codes(kinds: str, start: int, end: int) -> list[str]:
    """The macro edits of a chunk's rows."""
    out = []
    for before in reversed(solved(kinds, start)[0]):
        end, code = before[end]
        out.append(code)
    return out[::-1]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): the rows as the damage leaves them."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    out = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), (F.crc32(key.cast("binary")) % 20).alias("fault"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))).where("fault <> 0")
    fault, text = F.col("fault"), F.col("text")
    return out.select(
        "conv", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


_BLANKS = r"[\x20\x09-\x0D]"


def _skeleton(rows: DataFrame) -> DataFrame:
    """Equal rows once, without their texts: (conv, turn, role, digest, blank, open, n, first)."""
    text = F.col("text")
    keys = ["conv", "turn", "role", "digest"]
    flat = rows.select("conv", "turn", "role", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), "copies", (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(rf"[.!?]{_BLANKS}*\z")).alias("open"))
    once = flat.groupBy(*keys, "blank", "open").agg(F.sum("copies").alias("n"))
    # the turn at which a role says a text first; a null turn comes first
    said = once.where("not blank").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("at"), F.count("*").alias("times")).where("times > 1")
    again = said.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.turn").alias("at"))
    met = once.join(again, once.conv.eqNullSafe(again.c) & (once.role == again.r) & (once.digest == again.d), "left")
    out = met.select(*keys, "blank", "open", "n", (F.col("d").isNull() | F.col("turn").eqNullSafe(F.col("at"))).alias("first"))
    # no row stands for more copies than a chunk has room for
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
    return out.withColumn("from", part).select(*keys, "blank", "open", F.least(F.col("n") - F.col("from"), F.lit(CHUNK)).cast("long").alias("n"), "from", (F.col("first") & (F.col("from") == 0)).alias("first"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Sorted rows, CHUNK of a conversation to a row, with tables and counts."""
    conv = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartitionByRange("conv", "turn", "role", "digest", "from").sortWithinPartitions("conv", "turn", "role", "digest", "from")
    names = ["conv", "part", "no", "kinds", "turns", "roles", "digests", "sizes", "table", "blank", "duplicate", "truncated", "illegal", "distinct"]
    types = [None, *(pa.int64(),) * 2, pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), *(pa.int64(),) * 5]

    def run(batches):
        from pyspark import TaskContext

        part, no, own, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal no, own
            if own:
                kinds = "".join(own["kinds"])
                done.append([own["conv"], part, no, kinds, own["turns"], own["roles"], own["digests"], own["sizes"], table(kinds), *(own[c] for c in names[9:])])
                no, own = no + 1, None

        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for c, turn, role, digest, blank, is_open, n, _, first in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if own and (own["conv"] != c or own["rows"] + n > CHUNK):
                    close()
                if own is None:
                    own = {"conv": c, "rows": 0, "kinds": [], "turns": [], "roles": [], "digests": [], "sizes": []} | dict.fromkeys(names[9:], 0)
                initial = role[:1]
                kept = not blank and first
                likely = initial if initial in ("s", "u", "a") else "o"
                own["kinds"].append(((likely.upper() if is_open else likely) if kept else GONE) + GONE * (n - 1))
                own["blank"] += n if blank else 0
                own["duplicate"] += 0 if blank else n - first
                own["truncated"] += int(kept and is_open)
                own["illegal"] += n - 1  # no role may follow itself
                if own["roles"]:
                    own["illegal"] += own["roles"][-1][:1] + initial not in ("su", "ua", "au")
                own["distinct"] += turn is not None and (not own["turns"] or own["turns"][-1] != turn)
                own["rows"] += n
                for name, value in (("turns", turn), ("roles", role), ("digests", digest), ("sizes", n)):
                    own[name].append(value)
            if len(done) > 256:
                yield _batch(done, kind_of)
                done.clear()
        close()
        if done:
            yield _batch(done, kind_of)

    def _batch(some, kind_of):
        return pa.RecordBatch.from_arrays([pa.array(col, t or kind_of) for col, t in zip(zip(*some, strict=True), types, strict=True)], names)

    schema = f"conv {conv}, part long, no long, kinds string, turns array<long>, roles array<string>, digests array<binary>, sizes array<long>, table array<long>, " + ", ".join(f"{c} long" for c in names[9:])
    return ordered.mapInArrow(run, schema)


def _places(chunks: DataFrame) -> DataFrame:
    """Where each chunk begins and ends, and in the last row of a conversation its counts."""
    conv = chunks.schema["conv"].dataType.simpleString()
    narrow = chunks.select("conv", "part", "no", "table", F.filter("turns", lambda t: t.isNotNull()).alias("turns"), F.left(F.element_at("roles", 1), F.lit(1)).alias("a"), F.left(F.element_at("roles", -1), F.lit(1)).alias("z"), "blank", "duplicate", "truncated", "illegal", "distinct")
    narrow = narrow.select("conv", "part", "no", "table", F.try_element_at("turns", F.lit(1)).alias("lo"), F.try_element_at("turns", F.lit(-1)).alias("hi"), "a", "z", "blank", "duplicate", "truncated", "illegal", "distinct")
    ordered = narrow.repartition("conv").sortWithinPartitions("conv", "part", "no")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ["conv", "part", "no", "start", "end", "tail", *counts]

    def solve(rows):
        places, cost, tail = joined([r[3] for r in rows])
        sums = [sum(r[k] for r in rows) for k in range(8, 13)]
        for x, y in zip(rows, rows[1:], strict=False):
            sums[3] += x[7] + y[6] not in ("su", "ua", "au")
            sums[4] -= x[5] is not None and x[5] == y[4]
        turns = [t for r in rows for t in (r[4], r[5]) if t is not None]
        gaps = max(turns) - min(turns) + 1 - sums[4] if turns else 0
        last = len(rows) - 1
        return [(*r[:3], *at, *((tail, gaps, *sums[:4], cost) if k == last else (0, *(None,) * 6))) for k, (r, at) in enumerate(zip(rows, places, strict=True))]

    def run(batches):
        rows, done, kind_of = [], [], None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for r in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if rows and rows[0][0] != r[0]:
                    done += solve(rows)
                    rows = []
                rows.append(r)
            if len(done) > 1000:
                yield _batch(done, kind_of)
                done = []
        done += solve(rows) if rows else []
        if done:
            yield _batch(done, kind_of)

    def _batch(some, kind_of):
        return pa.RecordBatch.from_arrays([pa.array(col, pa.int64() if k else kind_of) for k, col in enumerate(zip(*some, strict=True))], names)

    return ordered.mapInArrow(run, f"conv {conv}, " + ", ".join(f"{n} long" for n in names[1:]))


def _decisions(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, edits): what is done with equal rows, one after another."""
    conv = chunks.schema["conv"].dataType.simpleString()
    met = chunks.select("conv", "part", "no", "kinds", "turns", "roles", "digests", "sizes").join(places.select("part", "no", "start", "end", "tail"), ["part", "no"])
    met = met.select("conv", "turns", "roles", "digests", "sizes", "kinds", "start", "end", "tail")

    def run(batches):
        for batch in batches:
            where, edits = [], []
            sizes, kinds, start, end, tail = (batch.column(k).to_pylist() for k in range(4, 9))
            for i in range(batch.num_rows):
                made, at = codes(kinds[i], start[i], end[i]), 0
                for n in sizes[i]:
                    edits.append("".join(made[at : at + n]))
                    where.append(i)
                    at += n
                edits[-1] += "I" * tail[i]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(batch.column(k).flatten() for k in (1, 2, 3)), pa.array(edits, pa.string())], ["conv", "turn", "role", "digest", "edits"])

    return met.mapInArrow(run, f"conv {conv}, turn long, role string, digest binary, edits string")


class _Repair:
    """The audit and the digest of one conversation, row by row."""

    def __init__(self):
        self.state, self.audit, self.hash, self.empty = 0, [], hashlib.sha256(), True

    def say(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def apply(self, edits: str, role: str, text: str) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "K":
                self.state = _KEPT[self.state, role[:1]]
                self.say(role, text)
            elif e in "IR":
                self.state = _INSERTED[self.state]
                self.say(_NAMES[self.state], text if e == "R" else "")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of
    every conversation of ``rows`` (conv_id, turn, role, text), damaged first."""
    spark = rows.sparkSession
    with small_batches(spark, 2000):
        left = damaged(rows)
        chunks = staged(_chunks(_skeleton(left)), "chunks")
        places = staged(_places(chunks), "places")
        edits = staged(_decisions(chunks, places), "edits")
    conv = left.schema["conv"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("edits", "string"), ("text", "string"), ("sums", "array<long>"))}
    shape = lambda df, step, **own: df.select("conv", F.lit(step).alias("step"), *(own.get(c, v).alias(c) for c, v in none.items()))
    c = F.col
    every = shape(rows.select(c("conv_id").alias("conv")).distinct(), 0)
    sums = shape(places.where("cost is not null"), 1, sums=F.array(*counts))
    keyed = {n: c(n) for n in ("turn", "role", "digest")}
    said = shape(left.withColumn("digest", F.unhex(F.sha2(c("text").cast("binary"), 256))), 3, **keyed, text=c("text"))
    # a row's edits come before its text: the order of a conversation's rows is that of its chunks
    stream = every.unionByName(sums).unionByName(shape(edits, 2, **keyed, edits=c("edits"))).unionByName(said)
    stream = stream.repartition("conv").sortWithinPartitions("conv", F.when(c("step") < 2, c("step")).otherwise(2), "turn", "role", "digest", "step")
    names = ["conv_id", *counts, "audit", "repaired_sha256"]

    def run(batches):
        own, sums, told, waiting, key, done, kind_of, begun = None, None, None, [], None, [], None, False

        def close():
            done.append((own, *(sums or (0,) * 6), "".join(told.audit), told.hash.hexdigest()))

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for who, step, turn, role, digest, edit, text, counted in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if not begun or who != own:
                    if begun:
                        close()
                    own, sums, told, waiting, begun = who, None, _Repair(), [], True
                if step == 1:
                    sums = counted
                elif step == 2:
                    waiting.append(edit)  # of one row, in pieces of CHUNK copies
                    key = (turn, role, digest)
                elif step == 3 and waiting and key == (turn, role, digest):
                    for edit in waiting:
                        told.apply(edit, role, text)
                    waiting = []
            if len(done) > 1000:
                yield _batch(done, kind_of)
                done.clear()
        if begun:
            close()
        if done:
            yield _batch(done, kind_of)

    def _batch(some, kind_of):
        types = [kind_of, *(pa.int64(),) * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*some, strict=True), types, strict=True)], names)

    return stream.mapInArrow(run, f"conv_id {conv}, " + ", ".join(f"{n} long" for n in counts) + ", audit string, repaired_sha256 string")


def _steps_sql() -> str:
    """Rows (state, edit, initial, next state, cost, code, turns inserted, role given) of all macro edits."""
    rows = []
    for q in range(4):
        at, said = q, []
        for n in range(3):
            ways = [("D", "", at, 3, ""), ("R", "", _INSERTED[at], 2, _NAMES[_INSERTED[at]]), *(("K", i, to, 0, "") for (s, i), to in _KEPT.items() if s == at)]
            rows += [f"({q}, '{edit}', '{i}', {to}, {2 * n + cost}, '{'I' * n + edit}', [{', '.join(said)}]::varchar[], '{name}')" for edit, i, to, cost, name in ways]
            at = _INSERTED[at]
            said.append(f"'{_NAMES[at]}:'")
    return ", ".join(rows)


#: The same in DuckDB SQL, over the table conversations: whole audits, row after row.
SQL = f"""with recursive k as (select conv_id conv, turn, coalesce(role, ' ') r0, coalesce(text, ' ') t0, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') s from conversations),
 f as (select *, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(s, ''), lambda c: ascii(c)::ubigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20)::int fault from k),
 d as (select conv, turn, case fault when 4 then 'user' else r0 end as role, case fault when 1 then '' when 2 then regexp_replace(t0, '[.!?]', '', 'g') else t0 end as text, unnest(range(case fault when 3 then 2 else 1 end)) nth from f where fault <> 0),
 o as (select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text), nth) pos, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') bare from d),
 x as (select *, bare = '' gone, row_number() over (partition by conv, role, text order by pos) > 1 again, not regexp_matches(bare, '[.!?]$') cut, left(role, 1) i, left(lag(role) over (partition by conv order by pos), 1) || left(role, 1) pair from o),
 t(q, edit, init, dest, cost, code, ins, named) as (values {_steps_sql()}),
 p(conv, pos, q, best) as (select distinct conv, 0::bigint, 0, {{'c': 0::bigint, 'a': '', 's': []::varchar[]}} from x
  union all select p.conv, p.pos + 1, t.dest, min({{'c': p.best.c + t.cost + case when t.edit <> 'D' and x.cut then 1 else 0 end, 'a': p.best.a || t.code, 's': p.best.s || t.ins || case t.edit when 'K' then [x.role || ':' || x.text] when 'R' then [t.named || ':' || x.text] else []::varchar[] end}})
  from p join x on x.conv is not distinct from p.conv and x.pos = p.pos + 1 join t on t.q = p.q and (t.edit = 'D' or not (x.gone or x.again)) and (t.edit <> 'K' or t.init = x.i) group by 1, 2, 3),
 n as (select conv, count(*) rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (gone) blank, count(*) filter (again and not gone) duplicate, count(*) filter (cut and not gone and not again) truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from x group by 1),
 e as (select n.conv, min({{'c': best.c + case q when 2 then 2 when 1 then 4 else 0 end, 'a': best.a || case q when 2 then 'I' when 1 then 'II' else '' end, 's': best.s || case q when 2 then ['assistant:'] when 1 then ['user:', 'assistant:'] else []::varchar[] end}}) b from p join n on p.conv is not distinct from n.conv and p.pos = n.rows group by 1)
 select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') audit, sha256(coalesce(array_to_string(b.s, chr(10)), '')) repaired_sha256
 from (select distinct conv_id from conversations) a left join n on a.conv_id is not distinct from n.conv left join e on a.conv_id is not distinct from e.conv"""
