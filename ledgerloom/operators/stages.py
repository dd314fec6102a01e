"""Stages that callers bring: pure functions of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.folds import is_large


def transform(rows: DataFrame, stage: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Each Arrow batch through a pure function; ``schema`` is what it returns."""

    def run(batches):
        for batch in batches:
            yield stage(batch)

    return rows.mapInArrow(run, schema)


def large_only(rows: DataFrame, least: int = 10**9) -> DataFrame:
    """Transfers of at least an amount: a stage that needs no function at all."""
    return rows.where(is_large(F.col("value"), least))
