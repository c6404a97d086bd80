"""Removal of lines that many documents repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scale import pinned
from palimpsest.llm.common import SPACES, heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

#: Shorter keys are never looked at, and keys in fewer documents stay.
MIN_CHARS, MIN_DOCS = 40, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the quick way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _occurrences(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``_key, _text, _at, _a, _b`` of each line long enough: its document, its place, and two hashes of its key."""
    lines = docs.select(F.col(key).alias("_key"), F.xxhash64(_whole(text)).alias("_text"),
                        F.posexplode(F.split(_ascii_lower(_whole(text)), "\n", -1)).alias("_at", "_line"))
    lines = lines.withColumn("_line", F.trim("_line", F.lit(SPACES))).where(F.char_length("_line") >= min_chars)
    return lines.select("_key", "_text", "_at", F.xxhash64(F.lit(1), "_line").alias("_a"), F.xxhash64(F.lit(2), "_line").alias("_b"))


def dropped_places(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``_key, _text, _drop``: the places (from 0) of the lines that go, per document that loses any.

    ``_text`` is a hash of the text, which tells rows with the same key apart.
    Lines travel as two 64-bit hashes of their keys.  A hash is first reduced
    to one row per document, then counted with partial sums, so a line that a
    third of all documents hold is one row per task; on the way back such
    lines are looked up by broadcast (:func:`~palimpsest.llm.common.heavy`).
    """
    found = materialize(_occurrences(docs, key, text, min_chars), "lines")
    once = found.select("_a", "_b", "_key").distinct()
    counts = once.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_docs"), F.max("_key").alias("_keep"))
    repeated = materialize(counts.where(F.col("_docs") >= min_docs), "lines-repeated")
    hot = materialize(heavy(repeated, "_docs", found.count()), "lines-hot")
    met = join_unique(found, repeated, ["_a", "_b"], hot, "inner").where(~F.col("_key").eqNullSafe(F.col("_keep")))
    return materialize(met.groupBy("_key", "_text").agg(F.collect_set("_at").alias("_drop")), "lines-dropped")


def _reassembled(docs: DataFrame, key: str, text: str, min_chars: int, min_docs: int, *columns: Column) -> DataFrame:
    """``columns`` with ``_lines``, ``_drop`` and ``_kept``, the text without the lines that go (null where none goes)."""
    drops = dropped_places(docs, key, text, min_chars, min_docs)
    rows = docs.select(*columns, F.col(key).alias("_id"), F.xxhash64(_whole(text)).alias("_hash"), _whole(text).alias("_whole"))
    rows = rows.join(drops, rows["_id"].eqNullSafe(drops["_key"]) & (rows["_hash"] == drops["_text"]), "left")
    rows = rows.withColumn("_lines", pinned(F.split("_whole", "\n", -1)))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")
    return rows.withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with all its columns, its texts without the lines that many documents repeat.

    A text is split at ``\\n``.  A line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose
    all their lines, except in the document with the largest ``key`` that
    holds them, which keeps each.  What stays is joined by ``\\n``, in order.
    Rows with the same ``key`` are one document; null keys are one too, the
    smallest.  Null and empty texts are one empty line and stay as they are;
    a text whose lines all go becomes empty; an empty table gives none.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    kept = _reassembled(docs, key, text, min_chars, min_docs, row)
    return kept.select(*[(F.coalesce("_kept", F.col(f"_row.`{c}`")) if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key, n_lines, n_dropped, kept_sha256`` of every row, by the rules of :func:`drop_repeated_lines`."""
    kept = _reassembled(docs, key, text, min_chars, min_docs)
    return kept.select(F.col("_id").alias(key), F.size("_lines").cast("long").alias("n_lines"),
                       F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("_kept", "_whole"), 256).alias("kept_sha256"))


@query("op13_line_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line,
    translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keep AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r""")
def line_dedup(spark, sf):
    return line_digests(table(spark, sf, "documents"))
