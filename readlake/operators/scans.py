"""Ordered scans over owners of any size: rows are dealt by ranges of owner and order, each range is scanned by itself,
and what it hands to the next range of the same owner is a small table.  So one owner with most of the rows spreads
over as many tasks as its rows need, and no window runs over a whole owner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from readlake.scratch import written


def in_ranges(rows: DataFrame, owner: list[str], order: list[str], scan: Callable[[Iterator[tuple]], Iterator[list]], more: list[StructField]) -> DataFrame:
    """``rows`` with ``_part``, the number of their range, and the columns that ``scan`` adds, written once.

    ``scan`` gets (batch, whether a row's owner differs from the row before it in the range) for the sorted batches of
    a range and gives the new columns of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = TaskContext.get().partitionId(), []

        def marked() -> Iterator[tuple]:
            last = None
            for batch in batches:
                if batch.num_rows:
                    columns = [batch.column(c) for c in owner]
                    new = np.zeros(batch.num_rows, bool)
                    new[0] = last != [c[0].as_py() for c in columns]
                    last = [c[-1].as_py() for c in columns]
                    for c in columns:
                        a, b = c.slice(1), c.slice(0, len(c) - 1)
                        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                        new[1:] |= ~same.to_numpy(zero_copy_only=False)
                    kept[:] = [batch]
                    yield batch, new

        for columns in scan(marked()):
            batch = kept[0]
            names = [*batch.schema.names, "_part", *(f.name for f in more)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *columns], names=names)

    keys = [*owner, *order]
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), *more])
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))


def _carried(placed: DataFrame, carries: DataFrame, owner: list[str]) -> DataFrame:
    """``placed`` as p beside the one row of ``carries`` as c for its owner and range."""
    same = F.col("p._part") == F.col("c._part")
    for name in owner:
        same &= F.col(f"p.{name}").eqNullSafe(F.col(f"c.{name}"))
    return placed.alias("p").join(carries.alias("c"), same)


def running_sums(rows: DataFrame, owner: list[str], order: list[str], **measures: Column) -> DataFrame:
    """``rows`` with place (from 1 in the owner's order) and, for each measure, its sum over the owner's rows before
    and, as ``<measure>_all``, over all of them.  Nulls count as nothing; what is equal in owner and order keeps any order.
    """
    names = ["place", *measures]
    wide = rows.withColumns({"_own_place": F.lit(1).cast("long")} | {f"_own_{m}": F.coalesce(c.cast("long"), F.lit(0)) for m, c in measures.items()})

    def scan(batches: Iterator[tuple]) -> Iterator[list]:
        carry = dict.fromkeys(names, 0)
        for batch, new in batches:
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            out = []
            for name in names:
                total = np.concatenate([[0], np.cumsum(batch.column(f"_own_{name}").to_numpy())])
                # rows ahead of the batch's first new owner go on from the batch before
                before = total[:-1] + np.where(first < 0, carry[name], -total[np.maximum(first, 0)])
                carry[name] = int(before[-1] + total[-1] - total[-2])
                out.append(pa.array(before))
            yield out

    placed = in_ranges(wide, owner, order, scan, [StructField(name, LongType()) for name in names])
    totals = placed.groupBy(*owner, "_part").agg(*(F.sum(f"_own_{m}").alias(f"_{m}") for m in names))
    # one row for each owner and range
    ahead = Window.partitionBy(*owner).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.withColumns({f"_{m}_before": F.coalesce(F.sum(f"_{m}").over(ahead), F.lit(0)) for m in names} | {f"{m}_all": F.sum(f"_{m}").over(Window.partitionBy(*owner)) for m in names})
    sums = [(F.col(f"p.{m}") + F.col(f"c._{m}_before") + int(m == "place")).alias(m) for m in names]
    return _carried(placed, carries, owner).select(*(F.col(f"p.{c}") for c in rows.columns), *sums, *(F.col(f"c.{m}_all") for m in measures))


def with_previous(rows: DataFrame, owner: list[str], order: list[str], value: str, name: str = "previous") -> DataFrame:
    """``rows`` with the ``value`` of the owner's row before, null for its first."""
    kind = rows.schema[value].dataType

    def scan(batches: Iterator[tuple]) -> Iterator[list]:
        last = None
        for batch, new in batches:
            own = batch.column(value)
            at = pa.array(np.where(new, -1, np.arange(len(new)) - 1), pa.int64())
            known = pc.if_else(pc.greater_equal(at, 0), at, pa.nulls(len(new), pa.int64()))
            before = own.take(known)
            if not new[0] and last is not None:
                before = pa.concat_arrays([last, before.slice(1)])
            last = own.slice(len(own) - 1)
            yield [before, pa.array(new)]

    placed = in_ranges(rows, owner, order, scan, [StructField("_previous", kind), StructField("_first", BooleanType())])
    # each range's last value of an owner goes to the owner's next range
    keys = F.struct(*order)
    ends = placed.groupBy(*owner, "_part").agg(F.max_by(value, keys).alias("_last"))
    carries = ends.withColumn("_handed", F.lag("_last").over(Window.partitionBy(*owner).orderBy("_part"))).drop("_last")
    both = _carried(placed, carries, owner)
    return both.select(*(F.col(f"p.{c}") for c in rows.columns), F.when(F.col("p._first"), F.col("c._handed")).otherwise(F.col("p._previous")).alias(name))
