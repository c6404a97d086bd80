"""Ordered per-key computations that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Where
one key may hold a third of all rows, the helpers here cut the key's order axis
into blocks of fixed width, work inside ``(key, block)`` and carry one small
summary row per block forward.  The rows themselves are exchanged once, on
``(key, block)``; the join that brings the carried value back reuses that
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.session import cut_lineage

BLOCK = "_block"


def with_block(df: DataFrame, order_value: str | Column, width: float) -> DataFrame:
    """Add the block number of a numeric or timestamp order value."""
    value = F.col(order_value) if isinstance(order_value, str) else order_value
    return df.withColumn(BLOCK, F.floor(value.cast("double") / F.lit(float(width))).cast("long"))


def _carry(df: DataFrame, keys: Sequence[str], summary: DataFrame) -> DataFrame:
    """Left join ``summary`` on keys and block, null-safe on the keys."""
    if not keys:
        return df.join(summary, BLOCK, "left")
    s = summary.select(*[F.col(c).alias(f"_s_{c}") if c in (*keys, BLOCK) else F.col(c) for c in summary.columns])
    on = [df[k].eqNullSafe(s[f"_s_{k}"]) for k in keys] + [df[BLOCK] == s[f"_s_{BLOCK}"]]
    return df.join(s, on, "left").drop(*[f"_s_{k}" for k in (*keys, BLOCK)])


def number_rows(df: DataFrame, keys: Sequence[str], order_value: str, order: Sequence, out: str,
                width: float) -> DataFrame:
    """Exact 1-based row numbers per key, in ``order``."""
    df = with_block(df, order_value, width)
    local = df.withColumn(out, F.row_number().over(W.partitionBy(*keys, BLOCK).orderBy(*order)).cast("long"))
    per_block = df.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return _carry(local, keys, offsets).withColumn(out, F.col(out) + F.col("_off")).drop("_off", BLOCK)


def running_sum(df: DataFrame, keys: Sequence[str], order_value: str, order: Sequence, value: Column, out: str,
                width: float, inclusive: bool = True) -> DataFrame:
    """Running total per key, in ``order``; exclusive of the row itself on demand."""
    df = with_block(df, order_value, width).withColumn("_v", value)
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    per_block = df.groupBy(*keys, BLOCK).agg(F.sum("_v").alias("_n"))
    return carry_offsets(local, keys, per_block, out).drop("_v")


def carry_offsets(local: DataFrame, keys: Sequence[str], per_block: DataFrame, out: str) -> DataFrame:
    """``out``, a sum within a block, as a sum from the key's first block on; ``per_block`` has the blocks' sums as ``_n``."""
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return _carry(local, keys, offsets).withColumn(out, F.col(out) + F.col("_off")).drop("_off", BLOCK)


def running_min(df: DataFrame, keys: Sequence[str], order_value: str, value: str, out: str, width: float) -> DataFrame:
    """Smallest ``value`` at or before each row, per key."""
    df = with_block(df, order_value, width)
    inside = W.partitionBy(*keys, BLOCK).orderBy(order_value).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn(out, F.min(value).over(inside))
    per_block = df.groupBy(*keys, BLOCK).agg(F.min(value).alias("_m"))
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    lows = per_block.select(*keys, BLOCK, F.min("_m").over(before).alias("_off"))
    return _carry(local, keys, lows).withColumn(out, F.least(out, "_off")).drop("_off", BLOCK)


def carry_last(df: DataFrame, keys: Sequence[str], order_value: str, order: Sequence, value: Column, out: str,
               width: float, inclusive: bool = True) -> DataFrame:
    """Latest non-null ``value`` at or before each row (an as-of fill).

    ``order`` must be made of plain column names and be unique within a key.
    """
    df = with_block(df, order_value, width).withColumn("_v", value)
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumn(out, F.last("_v", ignorenulls=True).over(inside))
    per_block = (
        df.where(F.col("_v").isNotNull())
        .groupBy(*keys, BLOCK)
        .agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    )
    blocks = df.select(*keys, BLOCK).distinct()
    filled = _carry(blocks, keys, per_block)
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = filled.select(*keys, BLOCK, F.last("_l", ignorenulls=True).over(before).alias("_off"))
    return _carry(local, keys, carried).withColumn(out, F.coalesce(out, "_off")).drop("_off", "_v", BLOCK)


def previous(df: DataFrame, keys: Sequence[str], order_value: str, order: Sequence, value: Column, out: str,
             width: float) -> DataFrame:
    """``value`` of the row before, per key (null on the first row)."""
    wrapped = F.struct(value.alias("v"))
    return (
        carry_last(df, keys, order_value, order, wrapped, "_prev", width, inclusive=False)
        .withColumn(out, F.col("_prev.v"))
        .drop("_prev")
    )


def spread_topk(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    Spark prunes to ``k`` rows per key on the map side before the exchange
    (``WindowGroupLimit``), so a hot key ships ``k`` rows per task.
    """
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def pinned(column: Column) -> Column:
    """``column``, computed once where it is written.

    Spark moves filters below projections by copying the projected expression
    into the filter.  For an expensive column that means running it again, and
    for a chain of such columns again and again.  Filters do not move past a
    non-deterministic column, so the (always true) test keeps it in place.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """One exchange on ``key`` ahead of CPU-heavy work.

    The partition count is stated, so that adaptive execution does not merge
    partitions by their (small) bytes and leave the work to a few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, key)


#: Characters of text that a task should get where it holds many small rows for each of them.
TASK_CHARS = 1_000_000


def by_key_and_size(df: DataFrame, key: str, text: str, chars: int = TASK_CHARS) -> DataFrame:
    """:func:`by_key` with as many partitions as the texts take at about ``chars`` each, so that a task's memory does not grow with the input."""
    total = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-total // chars)), key)


#: A key is hot if it holds more than one row in this many, so there are fewer hot keys than that.
HOT_SHARE = 1024


def attach(rows: DataFrame, facts: DataFrame, on: Sequence[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``facts``, which has each key once and tells in ``weight`` how many rows ask for it.

    Hot keys (fewer than :data:`HOT_SHARE`) are looked up by broadcast, so that
    none of them is dealt to a single task; the others are exchanged.  Both
    tables are read twice and should be cheap to read.
    """
    on = list(on)
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = facts.where(F.col(weight) * HOT_SHARE > F.lit(total))
    often = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts, on, how)
    return often.unionByName(rest)


def tiled_join(left: DataFrame, right: DataFrame, on: Sequence[str], bound: int = 4096) -> DataFrame:
    """Inner join where a key may have many rows on both sides.

    The rows of such a key are cut into parts of about ``bound`` rows, and each
    part of one side meets each of the other in a group of its own.  So a task
    never gets more than about ``bound`` rows a side of one key, and a key
    spreads over as many tasks as it has pairs of parts.  The sides are read
    several times and should be cheap to read; rows must differ from each
    other, as parts are made by a hash of the whole row.
    """
    on = list(on)
    n = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_nl")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_nr")), on)
    parts = [F.ceil(F.col(c) / bound).cast("int").alias(p) for c, p in (("_nl", "_lp"), ("_nr", "_rp"))]
    wide = cut_lineage(n.where(F.greatest("_nl", "_nr") > bound).select(*on, *parts, (F.col("_nl") + F.col("_nr")).alias("_n")))
    if wide.isEmpty():
        return left.join(right, on)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*rows.columns), F.coalesce(own, F.lit(1))).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        names = ("_l", "_r") if own == "_lp" else ("_r", "_l")
        return attach(rows, wide, on, "_n").select(*rows.columns, part.alias(names[0]), each.alias(names[1]))

    return dealt(left, "_lp", "_rp").join(dealt(right, "_rp", "_lp"), [*on, "_l", "_r"]).drop("_l", "_r")
