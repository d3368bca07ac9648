"""Filter interaction audit from a histogram of failure masks.

Five filters judge every whole text; what a text fails is one five-bit mask.  All
orders of the filters, step by step, follow from how many documents have each mask, so
texts are read once and nothing but 32 counts a part is kept:

A  fewer than ``MIN_WORDS`` words      B  100 * distinct words < ``MIN_DISTINCT`` * words
C  100 * [A-Z] > ``MAX_CAPITALS`` * signs   D  holds a sign of ``[#$%&*|]``
E  equals the text of a smaller id, anywhere in the table

A word is a maximal run of signs other than ``[\\x20\\x09-\\x0D]``, case-sensitive.
Texts meet by their SHA-256.  Rows of one digest are counted by part, mask and labels
before they are shuffled by it, so a text that a third of the rows hold brings a few
rows to one task.  Only built-in expressions are used.

Defined results: a null text is the empty text (it fails A alone, or A and E); a null
part is the empty string; rows of one id and text are equal, none of them comes before
another, so they fail E alike; a null id comes after all ids; an id that ``labels`` has
several times is good or toxic if one of its rows says so; ids without labels are
neither; an empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
FILTERS = "ABCDE"
_BLANKS = r"[\x20\x09-\x0D]+"
_LATER = 16  # the bit of E
#: Each step of each order: the bit of its filter and the bits of the filters before it.
_STEPS = [{"filter_order": "".join(order), "step": k + 1, "bit": 1 << FILTERS.index(f), "prev": sum(1 << FILTERS.index(x) for x in order[:k])} for order in permutations(FILTERS) for k, f in enumerate(order)]
_N_ORDERS = len(_STEPS) // len(FILTERS)


def text_mask(text: Column) -> Column:
    """The bits of A to D."""
    words = F.split(text, _BLANKS)  # empty at the ends where a text begins or ends with blanks
    first, last = (words[0] == "").cast("int"), ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    n, distinct = F.size(words) - first - last, F.size(F.array_distinct(words)) - F.greatest(first, last)
    capitals = F.size(F.split(text, "[A-Z]")) - 1
    fails = (n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT, capitals * 100 > F.length(text) * MAX_CAPITALS, text.rlike("[#$%&*|]"))
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail just these filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.sha2(text.cast("binary"), 256).alias("digest"))
    # equal rows once, with their number; ids then differ within a digest
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("copies"))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, "id", "left").fillna(0, ["good", "toxic"])
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    some = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("copies").alias("n"), F.min(order).alias("least"), F.min_by("copies", order).alias("first"))
    # a digest now has a row for each part, mask and label at most
    least = F.min("least").over(Window.partitionBy("digest"))
    some = some.withColumn("free", F.when(F.col("least").eqNullSafe(least), F.col("first")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("free").alias("n")), F.struct((F.col("mask") + _LATER).alias("mask"), (F.col("n") - F.col("free")).alias("n")))
    cell = some.select("part", "good", "toxic", F.inline(both))
    return cell.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).where("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step, zeros included: (part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    cells = mask_cells(docs, labels, part, id_col, text_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = F.from_json(F.lit(json.dumps(_STEPS)), "array<struct<filter_order: string, step: int, bit: int, prev: int>>")
    rows = cells.select("part", "cells", F.inline(steps))
    bit, prev = F.col("bit"), F.col("prev")
    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(prev) != 0

    def total(value, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + value(c))

    # of the orders of all filters, the filter comes first among those that a mask fails in one of so many
    share = lambda c: (F.lit(_N_ORDERS) / F.bit_count(c["mask"])).cast("long")
    here = lambda c: fails(c) & ~gone(c)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda c: c["mask"].bitwiseAND(prev + bit) == 0).alias("kept"), total(lambda c: c["n"], here).alias("removed"),
        total(lambda c: c["n"], lambda c: fails(c) & gone(c)).alias("redundant"), total(lambda c: c["n"], lambda c: c["mask"] == bit).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"), total(lambda c: c["toxic"], here).alias("toxic_lost"), total(lambda c: c["n"] * share(c), fails).alias("shapley"),
    )


#: The same in DuckDB SQL, over the tables documents and labels.
SQL = r"""with l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
 w as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
 m as (select w.doc_id, part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (coalesce(w.doc_id > min(w.doc_id) over (partition by t), w.doc_id is null and min(w.doc_id) over (partition by t) is not null))::int mask from w left join l on w.doc_id = l.doc_id),
 c as (select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
 f as (select unnest([0, 1, 2, 3, 4]) i),
 p as (select [a.i, b.i, c.i, d.i, e.i] o from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
 s as (select array_to_string(list_transform(o, lambda x: chr((65 + x)::int)), '') filter_order, k step, (1 << o[k]) bit, list_sum(list_transform(o[1:k - 1], lambda x: 1 << x)) prev from p, (select unnest([1, 2, 3, 4, 5]) k)),
 z as (select filter_order, step::int step, bit::int bit, coalesce(prev, 0)::int prev from s)
 select part, filter_order, step, coalesce(sum(n) filter (mask & (prev + bit) = 0), 0)::bigint kept, coalesce(sum(n) filter (mask & bit <> 0 and mask & prev = 0), 0)::bigint removed, coalesce(sum(n) filter (mask & bit <> 0 and mask & prev <> 0), 0)::bigint redundant,
 coalesce(sum(n) filter (mask = bit), 0)::bigint unique_fails, coalesce(sum(good) filter (mask & bit <> 0 and mask & prev = 0), 0)::bigint good_lost, coalesce(sum(toxic) filter (mask & bit <> 0 and mask & prev = 0), 0)::bigint toxic_lost,
 coalesce(sum(n * 120 // greatest(1, bit_count(mask::int))) filter (mask & bit <> 0), 0)::bigint shapley from c, z group by 1, 2, 3"""
