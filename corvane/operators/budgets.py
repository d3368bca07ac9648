"""Model calls in batches of a token budget, with a bound on what is open at once.

Rows are dealt to partitions by their length and sorted by it, so rows of a batch are about
as long and little is padded.  A batch takes rows while its longest row times its number
stays within the budget.  In each task batches are handed to a few threads; no more than
``most_open`` rows wait for an answer, and rows leave with their batch as it is answered, in
any order: each carries its own columns, so nothing has to be put back in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import count_tokens


def bins(lengths: list[int], budget: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Bounds of batches of rows in a row; a row beyond the budget is a batch of its own."""
    lo = longest = 0
    for i, n in enumerate(lengths):
        if i > lo and (max(longest, n) * (i - lo + 1) > budget or i - lo >= most_rows):
            yield lo, i
            lo, longest = i, 0
        longest = max(longest, n)
    if lengths:
        yield lo, len(lengths)


def pumped(some: Iterator[tuple], generate: Callable[[list[str]], list[str]], most_open: int, threads: int) -> Iterator[tuple]:
    """(what, answers) of (what, prompts), as they come; at most ``most_open`` prompts wait, or one
    batch that is larger."""
    with ThreadPoolExecutor(threads) as pool:
        waiting, n_open = {}, 0

        def answered():
            nonlocal n_open
            for done in wait(waiting, return_when=FIRST_COMPLETED).done:
                what, n = waiting.pop(done)
                n_open -= n
                yield what, done.result()

        for what, prompts in some:
            while waiting and n_open + len(prompts) > most_open:
                yield from answered()
            waiting[pool.submit(generate, prompts)] = what, len(prompts)
            n_open += len(prompts)
        while waiting:
            yield from answered()


def completed(df: DataFrame, prompt: str, generate: Callable[[list[str]], list[str]], budget: int = 16_384, most_rows: int = 64, most_open: int = 500, threads: int = 4, output: str = "completion") -> DataFrame:
    """Adds ``generate``'s completions, and of each row's batch ``batch_rows`` and ``batch_tokens``,
    the tokens with padding; ``n_tokens`` are the row's own.  Null prompts are empty ones."""
    text = F.coalesce(F.col(f"`{prompt}`").cast("string"), F.lit(""))
    told = df.withColumn("n_tokens", count_tokens(text))
    ordered = told.repartitionByRange("n_tokens", F.xxhash64(text)).sortWithinPartitions("n_tokens")
    at = [c.lower() for c in df.columns].index(prompt.lower())
    if df.schema[at].dataType.simpleString() != "string":  # else the prompts are moved once, as the column that they are
        ordered, at = ordered.withColumn("__prompt", text), len(df.columns) + 1
    own, names = len(df.columns), [*df.columns, "n_tokens", output, "batch_rows", "batch_tokens"]

    def run(batches):
        def parts():
            for batch in batches:
                for lo, hi in bins(batch.column(own).to_pylist(), budget, most_rows):
                    part = batch.slice(lo, hi - lo)
                    yield part, [p or "" for p in part.column(at).to_pylist()]

        for part, answers in pumped(parts(), generate, most_open, threads):
            n, longest = part.num_rows, max(part.column(own).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: own + 1], pa.array(answers, pa.string()), pa.array([n] * n, pa.int32()), pa.array([n * longest] * n, pa.int64())], names)

    shape = told.withColumns({output: F.lit(None).cast("string"), "batch_rows": F.lit(None).cast("int"), "batch_tokens": F.lit(None).cast("long")})
    return ordered.mapInArrow(run, shape.schema)


def padding_share(done: DataFrame) -> DataFrame:
    """(n_batches, padding): how much of what the batches hold is padding."""
    total = F.sum(F.col("batch_tokens") / F.col("batch_rows"))
    return done.agg(F.round(F.sum(1 / F.col("batch_rows"))).cast("long").alias("n_batches"), F.when(total > 0, 1 - F.sum("n_tokens") / total).otherwise(0.0).alias("padding"))
