"""Ordered computations that never put one key's rows into a single task.

A window per key breaks once a key holds a large part of the table. Rows of a key are therefore cut into blocks by a
monotone function of the order column, windows run per (key, block), and only one row per block is ordered along the
whole key. There is one kind of plan for keys of any size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_BITS = 12
BLOCK = "_block"


def int_block(c: Column) -> Column:
    """Block of an integer order column: 4096 consecutive values."""
    return F.shiftright(c.cast("long"), BLOCK_BITS)


def minute_block(ts: Column) -> Column:
    """Block of a timestamp: its minute, counted on the local calendar so that it is monotone."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    return day * 1440 + F.hour(ts) * 60 + F.minute(ts)


def calendar_seconds(ts: Column) -> Column:
    """A timestamp as seconds, with fractions, counted on the local calendar so that they are monotone."""
    within = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return F.unix_date(F.to_date(ts)).cast("double") * 86400 + within


def before(keys: Sequence[str], order: Sequence[str]) -> Window:
    """All earlier rows of the same keys."""
    return (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str,
    counted: Column | None = None,
) -> DataFrame:
    """Zero-based position of each row within its keys along the order columns.

    With ``counted`` only such rows count. ``block`` must not decrease along the order. Rows are shuffled once by
    (key, block); block totals are summed before they move, and only they are ordered along the whole key.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    tagged = df.withColumn(BLOCK, block)
    totals = tagged.groupBy(*keys, BLOCK).agg(F.sum(one).alias("_total"))
    offsets = totals.select(
        *keys, BLOCK, F.sum("_total").over(before(keys, [BLOCK])).alias("_offset")
    )
    within = before([*keys, BLOCK], order)
    local = tagged.withColumn(name, F.coalesce(F.sum(one).over(within), F.lit(0)))
    joined = local.join(offsets, [*keys, BLOCK], "left")
    return joined.select(
        *df.columns, (F.col(name) + F.coalesce("_offset", F.lit(0))).alias(name)
    )


def block_count(df: DataFrame) -> int:
    """Blocks to cut a whole table or group into: as many as the session has shuffle partitions, which
    is where a table's size is stated, and 64 at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64)


def quantile_bounds(c: Column, blocks: int) -> Column:
    """Aggregate expression: ascending inner boundaries that split c into about equal blocks."""
    shares = [i / blocks for i in range(1, blocks)]
    return F.percentile_approx(c, shares, 20 * blocks)


def with_bound_block(df: DataFrame, value: str, bounds: str, most: int) -> DataFrame:
    """The rows with the number of boundaries below a value, of at most ``most``; equal values always share a block.

    A binary search, a projection to each halving, which stays in generated code.
    """
    rows = df.withColumn(BLOCK, F.lit(0))
    for step in [1 << i for i in reversed(range(most.bit_length()))]:
        below = F.get(F.col(bounds), F.col(BLOCK) + (step - 1)) < F.col(value)
        rows = rows.withColumn(BLOCK, F.col(BLOCK) + F.when(below, step).otherwise(0))
    return rows


def with_range_block(df: DataFrame, order: Column, blocks: int | None = None) -> DataFrame:
    """The rows with their block of an order column, by ranges that follow the data: about equal numbers of the table's
    rows each, so that a key whose rows crowd together in the order is cut as finely as one whose rows are spread.

    The ranges' bounds are one scalar subquery over the order column; rows that agree in it share a block.
    """
    value, blocks = order.cast("double"), blocks or block_count(df)
    cuts = df.agg(F.array_distinct(quantile_bounds(value, blocks))).scalar()
    tagged = df.withColumn("_value", value).withColumn("_cuts", cuts)
    return with_bound_block(tagged, "_value", "_cuts", blocks).drop("_value", "_cuts")


def dense_order(
    df: DataFrame, order: str, name: str = "ord", blocks: int | None = None
) -> DataFrame:
    """Zero-based rank by a unique numeric column over the whole table.

    The boundaries are one scalar subquery that rows and block totals share; the joined totals have
    at most a row per block. No job runs while the plan is built.
    """
    tagged = with_range_block(df, F.col(order), blocks)
    totals = tagged.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_total"))
    offsets = totals.select(
        BLOCK,
        F.coalesce(F.sum("_total").over(before([], [BLOCK])), F.lit(0)).alias("_offset"),
    )
    within = Window.partitionBy(BLOCK).orderBy(order)
    local = tagged.withColumn(name, F.row_number().over(within))
    joined = local.join(offsets, BLOCK)
    out = [c for c in df.columns if c != name]
    return joined.select(*out, (F.col(name) - 1 + F.col("_offset")).cast("long").alias(name))


def read_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Dense row numbers in the order a scan yields its rows (one offset per input split).

    Numbers of splits must mean the same in both readings of the input, which a scan guarantees and
    a shuffled input does not: anything but a scan with projections and filters is refused.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"^[\s+:-]*(Aggregate|Join|Window|Sort|Repartition|Generate|Distinct|Union|.*Limit)", plan, re.M):
        raise ValueError("read_order numbers the rows of a scan only; write the rows first")
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    split = F.shiftright("_id", 33)
    totals = tagged.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("_total"))
    offsets = totals.select(
        "_split",
        F.coalesce(F.sum("_total").over(before([], ["_split"])), F.lit(0)).alias("_offset"),
    )
    joined = tagged.withColumn("_split", split).join(offsets, "_split")
    number = F.col("_id") - F.shiftleft("_split", 33) + F.col("_offset")
    return joined.select(*[c for c in df.columns if c != name], number.alias(name))
