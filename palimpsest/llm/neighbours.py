"""Approximate nearest neighbours by inner product, over randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.llm.common import heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

#: Vectors that the centre is taken from at most.
SAMPLE = 8192
#: Rotations, each with a bit per dimension.
TURNS = 4
#: Vectors, and queries, that one task compares at a time.
BLOCK, QUERY_BLOCK = 4096, 2048
#: Standard deviations that an estimate may be off before a vector is left out.
SIGMAS = 2.5


def rotations(d: int, turns: int = TURNS, seed: int = 8) -> np.ndarray:
    """``turns`` random rotations of ``d`` dimensions, side by side."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(turns):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out)


@dataclass
class Codes:
    """One-bit codes of vectors about a centre: packed signs after each rotation, length of the remainder o, and <code, o>."""

    bits: np.ndarray
    norm: np.ndarray
    lean: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        rest = (x - centre) @ turn
        n, d = x.shape
        norm = np.linalg.norm(x - centre, axis=1)
        lean = np.abs(rest).reshape(n, -1, d).sum(axis=2) / (np.sqrt(d) * np.where(norm > 0, norm, 1)[:, None])
        return cls(np.packbits(rest > 0, axis=1), norm, np.where(lean > 0, lean, 1))

    def estimate(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors) and their standard errors.

        With o the unit remainder and x its code after a rotation, <o, q> is
        estimated without bias by <x, q> / <x, o>, and is off by about |q|
        times sqrt((1 - <x, o>^2) / <x, o>^2 / (d - 1)); the mean over the
        rotations is off by less.
        """
        d, turns = queries.shape[1], self.lean.shape[1]
        turned = (queries @ turn).astype(np.float32)
        signs = np.unpackbits(self.bits, axis=1, count=d * turns).astype(np.float32) * np.float32(2) - np.float32(1)
        scale = (self.norm[:, None] / self.lean / (turns * np.sqrt(d))).astype(np.float32)
        signs *= np.repeat(scale, d, axis=1)
        guess = turned @ signs.T + (queries @ centre)[:, None].astype(np.float32)
        off = np.sqrt((np.maximum(1 - self.lean**2, 0) / self.lean**2).sum(axis=1) / max(d - 1, 1)) / turns * self.norm
        size = np.linalg.norm(queries, axis=1)
        return guess, size[:, None] * (off + 1e-5 * (self.norm + np.linalg.norm(centre)))[None, :]


def nearest(queries: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query: places and exact inner products of those of ``x`` that the estimates leave among its ``k`` nearest."""
    codes = Codes.of(x, centre, turn)
    for at in range(0, len(queries), 256):
        some = queries[at:at + 256]
        guess, off = codes.estimate(some, centre, turn)
        off *= SIGMAS
        for q, g, o in zip(some, guess, off, strict=True):
            floor = np.partition(g - o, len(x) - k)[len(x) - k] if len(x) > k else -np.inf
            place = np.flatnonzero(g + o >= floor)
            # sums over the same number of terms in the same order: equal vectors have equal scores
            yield place, (x[place] * q).sum(axis=1)


def valid(embedding: str = "embedding"):
    """Vectors that take part: not null, not zero, no null and no non-finite component."""
    e = F.col(embedding)
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda v: v != 0)


def _matrix(column: pd.Series | pa.Array) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of all other vectors by inner product, ties to the smaller key.

    ``queries`` is a condition on ``vectors``.  Equal vectors are one, with
    its ``k + 1`` smallest keys (no answer needs more of them), so neither
    their number as vectors nor as queries matters.  All queries meet all
    vectors, in blocks of both: codes and their errors choose what is scored
    exactly, in double precision, and each block gives its best.

    Vectors null, empty, zero or with null or non-finite components take no
    part, nor do rows with a null key.  Vectors of different lengths are not
    compared.  A key counts once per different vector.  With fewer than ``k``
    others, all are returned; an empty table returns none.
    """
    spark = vectors.sparkSession
    rows = vectors.where(valid(embedding) & F.col(key).isNotNull()).select(
        F.col(key).alias("_id"), F.transform(embedding, lambda v: v.cast("double") + F.lit(0.0)).alias("_v"), F.coalesce(queries, F.lit(False)).alias("_asks"))
    rows = rows.groupBy("_id", "_v").agg(F.max("_asks").alias("_asks")).withColumn("_same", F.md5(F.to_json("_v")))
    first = rows.withColumn("_place", F.row_number().over(W.partitionBy("_same", "_v").orderBy("_id"))).where(F.col("_place") <= k + 1)
    kinds = first.groupBy("_same", "_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")).withColumn("_d", F.size("_v"))
    kinds = materialize(kinds, "ann-kinds")
    asked = materialize(rows.where("_asks").select("_same", "_v", "_id").withColumn("_d", F.size("_v")), "ann-asked")
    lengths = {r._d: r["count"] for r in kinds.groupBy("_d").count().collect()}
    index = {}
    for d in lengths:
        sample = kinds.where(F.col("_d") == d).orderBy("_same").limit(SAMPLE).select("_v").toArrow()["_v"]
        index[d] = (_matrix(sample.to_pylist()).mean(axis=0), rotations(d))
    shared = spark.sparkContext.broadcast(index)
    different = asked.select("_same", "_v", "_d").distinct()
    blocks = max(1, -(-max(lengths.values(), default=0) // BLOCK))
    parts = max(1, -(-different.count() // QUERY_BLOCK))
    filed = kinds.withColumn("_block", F.pmod(F.xxhash64("_same"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asks = different.withColumn("_part", F.pmod(F.xxhash64("_same"), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(group: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query": pd.Series(dtype=object), "score": pd.Series(dtype=float), "ids": pd.Series(dtype=object)})
        names, ids, parts = q["_same"].to_numpy(), x["_ids"].to_numpy(), []
        for name, (place, score) in zip(names, nearest(_matrix(q["_v"]), _matrix(x["_v"]), *shared.value[group[0]], k + 1), strict=True):
            if len(score) > k + 1:  # the best, and what ties with the last of them
                keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                place, score = place[keep], score[keep]
            parts.append(pd.DataFrame({"query": name, "score": score, "ids": ids[place]}))
        return pd.concat(parts, ignore_index=True)

    keys = ["_d", "_block", "_part"]
    near = asks.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInPandas(compare, "query string, score double, ids array<long>")
    hits = near.select("query", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("_place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_place") <= k + 1)
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))).alias("near"))
    every = asked.select(F.col("_same").alias("query"), F.col("_id").alias("query_id")).distinct()
    lists = materialize(lists, "ann-lists")
    often = every.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
    total = every.count()
    hot = lists.join(heavy(often, "_n", total).select("query"), "query", "left_semi")
    answers = join_unique(every, lists, ["query"], hot, "inner")
    answers = answers.select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    answers = answers.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "hit"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.away")).alias("score"))


@query("op8_nearest")
def nearest_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
