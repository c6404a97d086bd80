"""Exact deduplication with skew-safe combining, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACES, heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

#: Parts that a hot digest's rows are dealt to before their winners are combined.
SALTS = 256
_SHIFT = "36893488147419103232"  # 2 ** 65: room for any doc_id below a difference in length


def normalised(text: Column) -> Column:
    """``text`` without any of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(points: Column, key: Column) -> Column:
    """One number that orders rows: more code points first, then the smaller key, a null key last."""
    first = F.coalesce(F.lit(2**63 - 1).cast("decimal(20,0)") - key.cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    return (points.cast("decimal(38,0)") * F.lit(_SHIFT).cast("decimal(38,0)") + first).cast("decimal(38,0)")


def _classes(docs: DataFrame, key: str, text: str, digest, hot: DataFrame) -> DataFrame:
    """A row for each different normalised text: its digest, its number of rows, and the row that stays.

    Equal texts are merged inside each task first (partial aggregation on
    digest *and* text), then per digest, with a salt where the digest is hot,
    and last over the salts.  The text is a grouping key each time, so texts
    of one digest that differ stay apart.
    """
    norm = normalised(F.col(text))
    rows = docs.select(norm.alias("_norm"), F.col(key).alias("_key"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_points"))
    rows = rows.withColumn("_digest", digest(F.col("_norm"))).withColumn("_rank", _rank(F.col("_points"), F.col("_key")))
    rows = rows.join(F.broadcast(hot.select("_digest", F.lit(True).alias("_hot"))), "_digest", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_key", "_points"), F.lit(SALTS)))
    salted = rows.withColumn("_salt", salt).groupBy("_digest", "_salt", "_norm").agg(
        F.max("_rank").alias("_rank"), F.max_by("_key", "_rank").alias("_key"), F.max("_points").alias("_points"), F.count(F.lit(1)).alias("_n"))
    # Without a salt a class is whole; its own winner tells it from others, and its text need not travel again.
    whole = F.col("_salt").isNull()
    winners = salted.select(
        "_digest", F.when(~whole, F.col("_norm")).alias("_norm"), F.when(whole, F.col("_rank")).alias("_own"), "_rank", "_key", "_points", "_n")
    return winners.groupBy("_digest", "_norm", "_own").agg(
        F.max_by("_key", "_rank").alias("_keep"), F.max("_points").alias("_keep_points"), F.sum("_n").alias("_size"))


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """Which rows stay: ``_key, _digest, _points, _rows, _keep, _keep_points, _size``, once per (key, digest, length).

    ``_rows`` counts the input rows it stands for.  ``digest`` maps a column to
    a string column; a weak one only costs time, as texts are compared whole.
    """
    slim = docs.select(F.col(key).alias("_key"), digest(normalised(F.col(text))).alias("_digest"),
                       F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_points"))
    slim = materialize(slim.groupBy("_key", "_digest", "_points").agg(F.count(F.lit(1)).alias("_rows")), "exact-rows")
    total = slim.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    per_digest = slim.groupBy("_digest").agg(F.sum("_rows").alias("_total"))
    hot = materialize(heavy(per_digest.where("_total > 1"), "_total", total), "exact-hot")
    classes = _classes(docs, key, text, digest, hot)
    repeated = materialize(classes.where("_size > 1").select("_digest", "_keep", "_keep_points", "_size"), "exact-classes")
    shared = per_digest.where("_total > 1").join(
        repeated.select("_digest", F.col("_size").alias("_total")), ["_digest", "_total"], "left_anti").select("_digest")
    shared = materialize(shared, "exact-shared")
    if shared.isEmpty():
        return join_unique(slim, repeated, ["_digest"], heavy(repeated, "_size", total)).select(
            "_key", "_digest", "_points", "_rows", *_stays())
    # Different texts under one digest: their rows are told apart by the text itself.
    alone = repeated.join(shared, "_digest", "left_anti")
    plain = join_unique(slim.join(shared, "_digest", "left_anti"), alone, ["_digest"], heavy(alone, "_size", total))
    rows = docs.select(F.col(key).alias("_key"), normalised(F.col(text)).alias("_norm"),
                       F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_points"))
    rows = rows.withColumn("_digest", digest(F.col("_norm"))).join(shared, "_digest", "left_semi")
    best = rows.withColumn("_rank", _rank(F.col("_points"), F.col("_key"))).groupBy("_digest", "_norm").agg(
        F.max_by("_key", "_rank").alias("_keep"), F.max("_points").alias("_keep_points"), F.count(F.lit(1)).alias("_size"))
    rows = rows.groupBy("_key", "_digest", "_norm", "_points").agg(F.count(F.lit(1)).alias("_rows"))
    mixed = rows.join(best, ["_digest", "_norm"]).drop("_norm")
    columns = ["_key", "_digest", "_points", "_rows", *_stays()]
    return plain.select(*columns).unionByName(mixed.select(*columns))


def _stays() -> list[Column]:
    lone = F.col("_size").isNull()
    return [F.when(lone, F.col("_key")).otherwise(F.col("_keep")).alias("_keep"),
            F.coalesce("_keep_points", "_points").alias("_keep_points"), F.coalesce("_size", F.col("_rows")).alias("_size")]


def _wins() -> Column:
    return F.col("_key").eqNullSafe(F.col("_keep")) & (F.col("_points") == F.col("_keep_points"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space (``[\\x20\\x09-\\x0D]``).
    Of equal texts the row with the most code points stays, then the smallest
    key, a null key last.  A null text counts as empty.  Of rows that repeat
    key and text, one is kept.  An empty table gives none; other columns are
    not read.
    """
    out = decide(docs, key, text, digest).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return out.select(F.col("_key").alias(key), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
                      (_wins() & (F.col("_copy") == 1)).alias("kept"), F.col("_digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    verdict = materialize(decide(docs, key, text).where(~_wins() | (F.col("_rows") > 1)).select(
        "_key", "_digest", "_points", (F.col("_rows") > 1).alias("_again"), _wins().alias("_won")), "exact-verdict")
    columns = docs.columns
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(key).alias("_key"),
        sha256(normalised(F.col(text))).alias("_digest"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_points"))

    def on(v: DataFrame) -> Column:
        return marked["_key"].eqNullSafe(v["_key"]) & (marked["_digest"] == v["_digest"]) & (marked["_points"] == v["_points"])

    left = marked.join(verdict, on(verdict), "left_anti").select("_row.*")
    again = verdict.where("_won and _again")
    if again.isEmpty():
        return left
    one = marked.join(again, on(again), "left_semi").groupBy("_key", "_digest", "_points").agg(
        F.min_by("_row", F.struct(F.col(f"_row.{text}"), F.to_json("_row"))).alias("_row"))
    return left.unionByName(one.select("_row.*"))


@query("op7_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept FROM t
  WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r""")
def exact_dedup(spark, sf):
    return exact_groups(table(spark, sf, "documents"))
