"""Running sums and neighbours within groups of any size.

A window needs all rows of a group in one task. Here rows are sorted into ranges over (keys, order), so that a
huge group is many ranges; each range works on its own rows, and what a range owes to those before it is carried over.
Only the first group of a range can have begun earlier, so there is at most one carried row for each range: that
is the proven size of what is broadcast.

Ranges are checkpointed, as both passes must see the same rows in the same range. Cases: rows of equal order
stand in one range in no set order (give an order without ties); null keys are a group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut


def spread(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows with `__range`, dealt by ranges of keys and order; `sums` and `before` work on it, `done` takes the column off.

    made: what becomes of the dealt rows, each by itself. Dealing reads rows twice (for bounds first), so what is dear belongs there.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    return cut(made(dealt.withColumn("__range", F.spark_partition_id())))


def done(rows: DataFrame) -> DataFrame:
    return rows.drop("__range")


def _carried(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `__carry` of their range and keys; ends has one row a range at most."""
    on = F.col("__range") == F.col("__of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    named = ends.select(F.col("__range").alias("__of"), *[F.col(k).alias(f"__{k}") for k in keys], "__carry")
    return rows.join(F.broadcast(named), on, "left").drop("__of", *[f"__{k}" for k in keys])


def _ends(rows: DataFrame, keys: list[str], last: Column, carry) -> DataFrame:
    """What groups of several ranges bring into each: carry(window over the ranges before). last: an aggregate of a range's own rows."""
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    of_range = rows.groupBy("__range", *keys).agg(last.alias("__last")).withColumn("__ranges", several).where("__ranges > 1")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return of_range.select("__range", *keys, carry(before).alias("__carry"))


def sums(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds running sums (first row of the keys to this one, by `order`); null counts as nothing. F.lit(1) numbers rows."""
    held = rows.withColumns({f"__{n}": v for n, v in values.items()})
    total = F.struct(*[F.sum(f"__{n}").alias(n) for n in values])
    ends = _ends(held, keys, total, lambda w: F.struct(*[F.sum(F.col("__last")[n]).over(w).alias(n) for n in values]))
    own = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _carried(held, ends, keys)
    made = {n: F.coalesce(F.sum(f"__{n}").over(own), F.lit(0)) + F.coalesce(F.col("__carry")[n], F.lit(0)) for n in values}
    return out.withColumns(made).drop("__carry", *[f"__{n}" for n in values])


def before(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], known: bool = False) -> DataFrame:
    """Adds columns of the row before within the keys, by `order`; of the last row before where the value is not null, if `known`."""
    place = F.struct(*order)
    last = F.struct(*[F.max_by(v, F.when(v.isNotNull(), place) if known else place).alias(n) for n, v in values.items()])
    ends = _ends(rows, keys, last, lambda w: F.struct(*[F.last(F.col("__last")[n], known).over(w).alias(n) for n in values]))
    own = Window.partitionBy("__range", *keys).orderBy(*order)
    out = _carried(rows, ends, keys)
    if known:
        held = own.rowsBetween(Window.unboundedPreceding, -1)
        return out.withColumns({n: F.coalesce(F.last(v, True).over(held), F.col("__carry")[n]) for n, v in values.items()}).drop("__carry")
    out = out.withColumn("__first", F.row_number().over(own) == 1)
    return out.withColumns({n: F.when(F.col("__first"), F.col("__carry")[n]).otherwise(F.lag(v).over(own)) for n, v in values.items()}).drop("__carry", "__first")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Adds a row's number (from 1) within its keys by `order`: ranges are sorted and counted as they stream by, so that rows are shuffled once."""
    def count(batches):
        last, counted = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns, fresh = [batch.column(k) for k in keys], np.zeros(n, bool)
            for c in columns:
                # nulls are a group
                both = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
                fresh[1:] |= ~(pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | both)
            fresh[0] = [c[0].as_py() for c in columns] != last
            last, at = [c[n - 1].as_py() for c in columns], np.arange(n)
            # a group that goes on from the batch before began that many rows earlier
            places = at - np.maximum.accumulate(np.where(fresh, at, -counted)) + 1
            counted = int(places[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, name])

    schema = StructType([*rows.schema, StructField("__range", IntegerType()), StructField(name, LongType())])
    dealt = spread(rows, keys, order, ranges, lambda df: df.sortWithinPartitions(*keys, *order).mapInArrow(count, schema))
    ends = _ends(dealt, keys, F.max(name), lambda w: F.sum("__last").over(w))
    return done(_carried(dealt, ends, keys).withColumn(name, F.col(name) + F.coalesce("__carry", F.lit(0))).drop("__carry"))


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    return done(sums(spread(rows, keys, order, ranges), keys, order, values))


def previous(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], ranges: int | None = None, known: bool = False) -> DataFrame:
    return done(before(spread(rows, keys, order, ranges), keys, order, values, known))
