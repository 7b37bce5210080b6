"""Ordinals in the order of a whole table, or of each group of it, without a window that puts all rows or a group into one task.

The rows are sorted by ranges over the cluster and counted where they lie; what the tasks before hold of the same group comes from one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from civicframe.session import ship
from civicframe.storage import cut

PART, ROW, INSIDE, HEAD = "_part", "_row", "_inside", "_head"
ADDED = [StructField(PART, IntegerType()), StructField(ROW, LongType()), StructField(INSIDE, LongType()), StructField(HEAD, BooleanType())]


def _counted(by: str):
    """Adds to sorted rows their task, their place in it, their place among the task's rows of their group, and whether that is the task's first group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, inside, head = TaskContext.get().partitionId(), 0, None, 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            group = b.column(b.schema.get_field_index(by))
            before = pa.concat_arrays([group.slice(0, 1) if last is None else last, group.slice(0, n - 1)])
            same = pc.or_(pc.fill_null(pc.equal(group, before), False), pc.and_(pc.is_null(group), pc.is_null(before))).to_numpy(zero_copy_only=False)
            new = ~same
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + inside, at - start)
            first = head & (start < 0)
            arrays = [np.full(n, part, np.int32), at + row, place, first]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, arrays)], names=[*b.schema.names, PART, ROW, INSIDE, HEAD])
            last, row, inside, head = group.slice(n - 1, 1), row + n, int(place[-1]) + 1, bool(first[-1])

    return run


def _before(parts: list, whole: bool) -> list[tuple[int, int]]:
    """(task, rows of its first group in the tasks before it), of a row for each task: first and last group, the rows of both, all rows."""
    out, group, held = [], None, 0
    for p in sorted(parts, key=lambda p: p[PART]):
        carried = held if group is not None and (whole or p.first_by == group[0]) else 0
        out.append((p[PART], carried))
        alone = p.heads == p.n
        held = p.n + carried if whole or alone else p.last_n
        group = (p.last_by,)
    return out


def numbered(df: DataFrame, order: list[str | Column], by: str | None = None, name: str = "ordinal", start: int = 1) -> DataFrame:
    """``df`` with the place of each row (from ``start``) in the order of its columns ``order``, within each value of the column ``by`` if given.

    ``order`` may be expressions, null first or last as they say. Equal rows are put in the order in which they are read, so that one row that is repeated
    a million times is spread over the tasks, too. Null is a group of its own. An empty table gives no rows. The columns ``_part``, ``_row``, ``_inside``
    and ``_head`` are used on the way and mustn't be there.
    """
    if taken := {PART, ROW, INSIDE, HEAD} & {*df.columns}:
        raise ValueError(f"{', '.join(sorted(taken))}: names that numbering uses itself")
    ship(df.sparkSession)
    rows = df.withColumn(ROW, F.monotonically_increasing_id())
    keys = [*([by] if by else []), *order, ROW]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if by is None:  # the sorted place within the task is all that is needed
        at = F.monotonically_increasing_id()
        rows = cut(rows.drop(ROW).withColumns({PART: F.shiftright(at, 33).cast("int"), INSIDE: at.bitwiseAND((1 << 33) - 1)}), "ordered")
        parts = rows.groupBy(PART).agg(F.count("*").alias("n"), F.lit(1).alias("first_by"), F.lit(1).alias("last_by"), F.count("*").alias("heads"), F.count("*").alias("last_n"))
        met = F.lit(True)
    else:
        schema = StructType([f for f in rows.schema if f.name != ROW] + ADDED)
        rows = cut(rows.drop(ROW).mapInArrow(_counted(by), schema), "ordered")
        parts = rows.groupBy(PART).agg(F.count("*").alias("n"), F.min_by(by, ROW).alias("first_by"), F.max_by(by, ROW).alias("last_by"), F.count_if(HEAD).alias("heads"), (F.max_by(INSIDE, ROW) + 1).alias("last_n"))
        met = F.col(HEAD)
    before = [x for x in _before(parts.collect(), by is None) if x[1]]  # a row for each task
    offsets = df.sparkSession.createDataFrame(before, f"{PART} int, _before long")
    out = rows.join(F.broadcast(offsets), PART, "left")
    place = F.col(INSIDE) + F.when(met, F.coalesce("_before", F.lit(0))).otherwise(0) + start
    return out.withColumn(name, place.cast("long")).select(*[c for c in df.columns if c != name], name)
