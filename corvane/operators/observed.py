"""Counts that come with a write, in the same pass, and the time that it took."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    """What a write kept and left out, and how long it took."""

    n_kept: int
    n_skipped: int
    seconds: float

    @property
    def rows_per_minute(self) -> float:
        return self.n_kept / self.seconds * 60 if self.seconds > 0 else 0.0


def observed_filter(df: DataFrame, keep: Column) -> tuple[DataFrame, Observation]:
    """Rows that ``keep`` holds for; the observation has n_kept and n_skipped once they are written."""
    told = Observation()
    sure = F.coalesce(keep, F.lit(False))
    return df.observe(told, F.count_if(sure).alias("n_kept"), F.count_if(~sure).alias("n_skipped")).where(sure), told


def write_kept(df: DataFrame, keep: Column, path: str, kind: str = "parquet", mode: str = "overwrite") -> Outcome:
    """Writes the rows that ``keep`` holds for, in one job, and tells how many they were."""
    kept, told = observed_filter(df, keep)
    began = time.monotonic()
    kept.write.format(kind).mode(mode).save(path)
    found = told.get
    return Outcome(found["n_kept"], found["n_skipped"], time.monotonic() - began)
