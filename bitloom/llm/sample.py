"""Bounded, repeatable samples of rows for fitting models."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import held_by


def bounded(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows of df, never more than twice as many, chosen by a hash of the key: all of them if df has no more. The plan is the same at every size."""
    n = df.count()
    return df.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, rows / max(n, 1)))).limit(2 * rows)


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """fit(rows) in one task, for a bounded sample: the driver gets the model alone."""
    schema = rows.schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        held_by(None)
        held = list(batches)
        table = pa.Table.from_batches(held) if held else to_arrow_schema(schema).empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()  # an exchange: the scan and joins before it keep their tasks
    return pickle.loads(found["model"]) if found else fit(rows.limit(0).toArrow())  # no partition, no task
