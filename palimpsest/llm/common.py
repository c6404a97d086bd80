"""Helpers shared by the operators: materialising, hot keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.plans.tables import table
from palimpsest.session import ensure_checkpoint_dir

__all__ = ["HOT_SHARE", "components", "folder", "heavy", "join_unique", "materialize", "registry", "smallest", "table"]

#: A key is hot if it holds more than one row in this many; so there are at most this many hot keys.
HOT_SHARE = 1024

#: The six characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Two empty tables, queries and SQL by name, and the decorator that fills them."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                sqls[name] = sql
            return fn

        return add

    return queries, sqls, query


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Removes an execution's shuffle files at its end; else they stay until the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, any executor can read it, and its shuffle files go."""
    path, conf = folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEAN_UP, None)
    conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN_UP, before) if before is not None else conf.unset(_CLEAN_UP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy(counts: DataFrame, count: str, total: int) -> DataFrame:
    """The rows of ``counts`` whose ``count`` is over a :data:`HOT_SHARE`-th of ``total``: fewer than that many."""
    return counts.where(F.col(count) * HOT_SHARE > F.lit(total))


def join_unique(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has each key once.

    ``hot`` holds the rows of ``right`` that many rows of ``left`` ask for; it
    has a proven bound (:func:`heavy`) and is broadcast, so that no hot key is
    dealt to a single task.  The other rows are exchanged on the key, which
    must not be null.
    """
    on = list(on)
    few = F.broadcast(hot.select(*right.columns))
    often = left.join(few, on, "inner")
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right, on, how)
    return often.unionByName(rest)


def smallest(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """At least the ``k`` rows per key with the smallest ``order``, a 64-bit hash, and hardly more of them.

    Rows are counted by key and the first 12 bits of the hash, which says where
    the k-th one lies; so what comes to a task per key is about ``k`` rows,
    however many there are.  Keys are few (their cuts are broadcast).
    """
    part = F.shiftright(order, 52)
    n = df.groupBy(*keys, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    cut = n.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < k).groupBy(*keys).agg(F.max("_part").alias("_cut"))
    return df.join(F.broadcast(cut), list(keys)).where(part <= F.col("_cut")).drop("_cut")


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (``a``, ``b`` long): a row ``node, component`` per linked node.

    ``component`` is the smallest node reachable.  Alternating large- and
    small-star rounds (Kiveris et al. 2014): each points every node at the
    smallest node of its neighbourhood, which takes a number of rounds in the
    order of the logarithm.  Neighbourhoods are only ever reduced by ``min``
    (combined before the exchange), never gathered; each round's edges are
    written to the shared folder.  Self links and repeats are harmless; null
    ends are dropped; no links give an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    edges = materialize(edges.distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
