"""Ranks within size classes of a whole table, by one range sort."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace


def with_columns(x: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    """A batch with further columns; its own, ids among them, stay as they are."""
    return pa.RecordBatch.from_arrays([*x.columns, *more.values()], [*x.schema.names, *more])


def ranked(ws: Workspace, df: DataFrame, size: str, order: list[str], classes: int) -> tuple[DataFrame, dict[int, int]]:
    """df (written) with ``rank``, 0-based among rows of equal ``size`` in ``order``, and the count of each size.

    ``size`` takes at most ``classes`` whole values. The table is range-sorted,
    so a partition holds neighbouring sizes and all (partition, size) counts
    together are at most ``classes`` plus the number of partitions; only these
    reach the driver. A size that holds most rows spreads over many partitions.
    """
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int, place long"

    def number(frames):
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, 0
        for x in frames:
            s = x[size].to_numpy()
            if not len(s):
                continue
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))  # sorted: equal sizes are neighbours
            runs = np.diff(np.append(first, len(s)))
            base = np.zeros(len(first), dtype=np.int64)
            base[0] = held if s[0] == last else 0
            place = np.arange(len(s)) - np.repeat(first, runs) + np.repeat(base, runs)
            last, held = s[-1], int(place[-1]) + 1
            yield with_columns(x, part=pa.array(np.full(len(s), part, dtype=np.int32)), place=pa.array(place))

    laid = ws.cut(df.repartitionByRange(size, *order).sortWithinPartitions(size, *order).mapInArrow(number, schema), "ranked")
    counts = sorted((r[0], r[1], r[2]) for r in laid.groupBy(size, "part").agg(F.count("*")).collect())
    if len({c[0] for c in counts}) > classes:
        raise ValueError(f"{size} takes more than {classes} values")
    total: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}
    for v, part, n in counts:
        starts[part, v] = total.get(v, 0)
        total[v] = total.get(v, 0) + n
    shared = ws.spark.sparkContext.broadcast(starts)

    def shift(frames):
        for x in frames:
            add = [shared.value[k] for k in zip(x["part"].to_pylist(), x[size].to_pylist(), strict=True)]
            yield with_columns(x.select(names), rank=pa.array(x["place"].to_numpy() + np.array(add, dtype=np.int64)))

    # written, so that no task runs two Python functions in a row and with them two workers
    return ws.cut(laid.mapInArrow(shift, schema.replace(", part int, place long", ", rank long")), "ranks"), total


class Intervals:
    """Rows ``(class, first rank, ...)``; finds the row whose ranks hold a given (class, rank)."""

    def __init__(self, rows: list[tuple]) -> None:
        rows = sorted(rows)
        self.table = np.array(rows, dtype=np.int64).reshape(len(rows), -1)
        self.by: dict[int, tuple[int, int]] = {}
        for v in np.unique(self.table[:, 0]) if rows else []:
            c = self.table[:, 0].tolist()
            self.by[int(v)] = bisect.bisect_left(c, v), bisect.bisect_right(c, v)
        self.first = self.table[:, 1] if rows else np.empty(0, dtype=np.int64)

    def find(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Row numbers of the table; -1 where a class has none."""
        out = np.full(len(cls), -1, dtype=np.int64)
        for v in np.unique(cls):
            if int(v) in self.by:
                a, b = self.by[int(v)]
                rows = cls == v
                out[rows] = a + np.searchsorted(self.first[a:b], rank[rows], side="right") - 1
        return out
