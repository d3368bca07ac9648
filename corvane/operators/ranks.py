"""Row numbers over whole tables or groups of any size, without a window over them.

Rows are dealt to partitions by sampled bounds of the sort key, so each partition holds
the rows between two bounds; a row's rank is its place in its partition and the number of
rows in the partitions before.  What is counted is a row for each partition and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, MapType, StructField, StructType, VariantType

from corvane.sources.storage import shared_folder


def _hashable(kind: DataType) -> bool:
    return not isinstance(kind, MapType | VariantType) and all(_hashable(k) for k in (*(f.dataType for f in getattr(kind, "fields", ())), *([kind.elementType] if hasattr(kind, "elementType") else ())))


def _free(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def ranked(df: DataFrame, *order: Column, within: tuple[str, ...] = (), rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``rank``, from 1 in the given order, as row_number() over the whole table or over
    each group of ``within`` gives it, and ``total``, the number of rows ranked together.

    Nulls stand where the order puts them, and null groups are one group.  Rows that tie are
    ordered by a hash of all their columns; rows equal in all of them in any order.
    """
    spark = df.sparkSession
    part, n, base, all_ = _free(df, "part", "n", "base", "all")
    salt = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)))
    groups = [F.col(f"`{c}`") for c in within]
    path = shared_folder(spark, "ranks")
    df.repartitionByRange(*groups, *order, salt).withColumn(part, F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(StructType([*df.schema.fields, StructField(part, IntegerType())])).parquet(path)
    sizes = placed.groupBy(*groups, part).agg(F.count("*").alias(n))
    if within:
        own = Window.partitionBy(*groups)
        bases = sizes.withColumn(base, F.sum(n).over(own.orderBy(part)) - F.col(n)).withColumn(all_, F.sum(n).over(own))
    else:
        found, sums = sorted(tuple(r) for r in sizes.collect()), [0]  # as many as there are partitions
        for _, size in found:
            sums.append(sums[-1] + size)
        bases = spark.createDataFrame([(p, s, b, sums[-1]) for (p, s), b in zip(found, sums, strict=False)], f"`{part}` int, `{n}` long, `{base}` long, `{all_}` long")
    local = placed.withColumn(rank, F.row_number().over(Window.partitionBy(*groups, part).orderBy(*order, salt)).cast("long"))
    same = [local[f"`{c}`"].eqNullSafe(bases[f"`{c}`"]) for c in within]
    met = local.join(bases if within else F.broadcast(bases), reduce(lambda a, b: a & b, same, local[part] == bases[part]))
    kept = [local[f"`{c}`"] for c in df.columns if c != rank]
    return met.select(*kept, (local[rank] + bases[base]).alias(rank), *([bases[all_].alias(total)] if total else []))


def batched(df: DataFrame, size: int, *order: Column, within: tuple[str, ...] = (), batch: str = "batch") -> DataFrame:
    """Batches of a fixed size in the given order; what does not fill the last one is dropped."""
    rank, total = _free(df, "rank", "total")
    out = ranked(df, *order, within=within, rank=rank, total=total)
    return out.where(F.col(rank) <= F.col(total) - F.col(total) % size).withColumn(batch, F.floor((F.col(rank) - 1) / size)).drop(rank, total)
