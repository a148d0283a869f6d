"""Ordered work on whole series, whatever share of the rows a key or an instant holds.

Rows are dealt by ranges of key, order and tie, so neither a hot key nor a hot instant gathers in one task. Each task
walks its sorted rows once, in Arrow batches, and notes what only depends on the row before: the distance from it, and
the running number in its run of equal keys. What a run owes to the task before it, its border, is a matter of a few
rows per task, and is carried over afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import ship_package

#: The upper bits of a row's place name its task.
TASK_SHIFT = 33


def task_of(place: str | Column = "_i") -> Column:
    return F.shiftright(place, TASK_SHIFT)


def changes(columns: list[pa.Array], before: list[Any] | None) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; null equals null."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        here, last = c.slice(1), c.slice(0, n - 1)
        unlike = pc.fill_null(pc.not_equal(here, last), False).to_numpy(zero_copy_only=False)
        out[1:] |= unlike | (here.is_null().to_numpy(zero_copy_only=False) != last.is_null().to_numpy(zero_copy_only=False))
    out[0] = before is None or before != [c[0].as_py() for c in columns]
    return out


class Walk:
    """One task's rows in order: for each the number in its run, whether the run opened the task, and the distance from
    the value before it in the run."""

    def __init__(self, n_keys: int):
        self.n_keys = n_keys
        self.keys: list[Any] | None = None
        self.value: Any = None
        self.place, self.opening = 0, True

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        keys, value = batch.columns[: self.n_keys], batch.column(self.n_keys)
        new = changes(keys, self.keys)
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(start < 0, at + 1 + self.place, at - start + 1)
        # the first run of the task lasts until a later row starts another
        first = self.keys is None
        ends = np.flatnonzero(new[1:]) + 1 if first else np.flatnonzero(new)
        opening = (at < (ends[0] if len(ends) else n)) if self.opening else np.zeros(n, bool)
        before = pa.concat_arrays([pa.array([self.value], value.type), value.slice(0, n - 1)])
        apart = pc.if_else(pa.array(new), pa.scalar(None, value.type), pc.abs(pc.subtract(value, before)))
        self.keys = [c[n - 1].as_py() for c in keys]
        self.value, self.place, self.opening = value[n - 1].as_py(), int(place[-1]), bool(opening[-1])
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(place), pa.array(opening), apart], names=[*batch.schema.names, "_place", "_opens", "_apart"]
        )


def walked(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows in the order of ``keys`` and ``order``, with ``_i``, ``_place``, ``_opens`` and ``_apart``.

    ``_i`` is the place in the whole order, its upper bits the task; ``_place`` the number in the run of equal keys
    within the task, from 1; ``_opens`` says that the run is the task's first, so it may go on from the task before;
    ``_apart`` is the distance from the value before, null where a run or a task starts. Rows that agree in keys, order,
    value and ``keep`` are interchangeable. The raw rows are exchanged once.
    """
    ship_package(df.sparkSession)
    columns = [*keys, value, *keep]
    total = list(dict.fromkeys([*keys, *order, value, *keep]))
    # rows alike in everything are dealt by their place in the input, so that they can't gather either
    told = df.select(*total).withColumn("_tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(*total, "_tie").sortWithinPartitions(*total, "_tie")
    placed = dealt.select(*[F.col(c) for c in columns], F.monotonically_increasing_id().alias("_i"))
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.operators.series import Walk

        walk = Walk(n_keys)
        for batch in batches:
            if batch.num_rows:
                yield walk(batch)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    apart = placed.schema[value].dataType.simpleString()
    return placed.mapInArrow(run, f"{kinds}, _place bigint, _opens boolean, _apart {apart}")


def numbered(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_row``, the number of each row in its whole run, from 0, to written rows of ``walked``.

    Only the first run of a task can go on from an earlier one, so what is carried is at most one row per task.
    """
    runs = written.groupBy(task_of().alias("_task"), *keys).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    carried = runs.select("_task", F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
    joined = written.join(F.broadcast(carried), task_of() == F.col("_task"), "left").drop("_task")
    before = F.when(F.col("_opens"), F.coalesce("_before", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("_row", before + F.col("_place") - 1).drop("_before")
