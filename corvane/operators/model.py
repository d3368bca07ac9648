"""The model boundary: prompt tables in, completion tables back."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import has_words


def complete(df: DataFrame, prompt: str, generate: Callable[[list[str]], list[str]], output: str = "completion", batch: int = 16) -> DataFrame:
    """Adds ``generate``'s completions, made in small batches on the executors."""
    at, names = df.columns.index(prompt), [*df.columns, output]

    def run(batches):
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(generate(part.column(at).to_pylist()), pa.string())], names)

    return df.mapInArrow(run, df.withColumn(output, F.lit(None).cast("string")).schema)


def recorded(df: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """Joins completions made elsewhere; rows without one get null."""
    return df.join(completions, key, "left")


def with_fallback(df: DataFrame, draft: str, improved: str, output: str = "final_answer", words: int = 8) -> DataFrame:
    """Rows of an invalid draft go; an invalid improvement falls back to the draft."""
    d, i = F.col(draft), F.col(improved)
    return df.where(has_words(d, words)).withColumn(output, F.when(has_words(i, words), i).otherwise(d))
