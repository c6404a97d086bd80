"""Detection reports over a corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import detection as X
from palimpsest.functions import patterns as P
from palimpsest.functions.masking import preview_mask
from palimpsest.functions.splice import matches
from palimpsest.functions.text import strip
from palimpsest.operators.deident import kind_counts, merge_counts, scan_pass
from palimpsest.operators.similarity import line_array


def find_kind(df: DataFrame, kind: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every valid match of one kind: ``key, pos, value``."""
    t = X.normalize(F.col(text))
    return df.where(X.worth_trying(kind, t)).select(key, F.posexplode(X.find(kind, t)).alias("pos", "value"))


def scan_counts(df: DataFrame, *, by: Iterable[str] = (), ext: str | None = None, text: str = "text", **options) -> DataFrame:
    """Counts from the ordered pass; code-like inputs add secrets found in the raw text."""
    counts = kind_counts(scan_pass(df, "mask", text=text, **options), by)
    if ext is None:
        return counts
    raw = F.size(X.secrets(F.col(text))) + F.when(F.col(ext) == ".sql", F.size(X.sql_secrets(F.col(text)))).otherwise(0)
    secret = df.where(F.col(ext).isin(*P.SECRET_EXT)).groupBy(*by).agg(F.sum(raw).cast("long").alias("n")).where("n > 0")
    both = counts.unionByName(secret.select(*by, F.lit("secret").alias("kind"), "n"))
    return both.groupBy(*by, "kind").agg(F.sum("n").alias("n"))


def scan_independent(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Seven kinds counted independently on normalised text: ``kind, label, n``."""
    t = X.normalize(F.col(text))
    sums = df.select(t.alias("t")).agg(*[
        F.sum(X.count(kind, F.col("t"))).cast("long").alias(kind) for kind in P.INDEPENDENT_LABELS
    ])
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(label).alias("label"), F.col(k).alias("n"))
                        for k, label in P.INDEPENDENT_LABELS.items()])
    return sums.select(F.explode(entries).alias("e")).select("e.*").where("n > 0")


def precheck(df: DataFrame, categories: Iterable[str] = tuple(P.PRECHECK), *, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Line-wise findings with line number, span, preview and context.

    Spans come from the lengths of the gaps and matches before a finding.
    """
    lines = df.select(key, F.posexplode(line_array(F.col(text))).alias("n", "line"))
    parts = []
    for cat in categories:
        pat = P.PRECHECK[cat]
        found, gaps = matches(F.col("line"), pat), F.split(F.col("line"), pat, -1)
        hit = F.col("line").rlike(pat)
        parts.append(F.struct(F.lit(cat).alias("category"), F.when(hit, found).alias("v"), F.when(hit, gaps).alias("g")))
    per = lines.select(key, "n", "line", F.explode(F.array(*parts)).alias("c")).select(
        key, "n", "line", "c.category", "c.g", "c.v").where(F.size("v") > 0)
    rows = per.select(key, "n", "line", "category", "g", F.col("v").alias("all"), F.posexplode("v").alias("i", "value"))
    before = F.aggregate(F.slice("g", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(
        F.slice("all", F.lit(1), F.col("i")), F.lit(0), lambda a, s: a + F.length(s))
    masked, label, risk = (F.when(F.lit(False), F.lit(None).cast("string")) for _ in range(3))
    for cat in categories:
        is_cat = F.col("category") == cat
        masked = masked.when(is_cat, preview_mask(cat, F.col("value")))
        label, risk = label.when(is_cat, F.lit(P.PRECHECK_LABEL[cat])), risk.when(is_cat, F.lit(P.PRECHECK_RISK[cat]))
    return rows.withColumn("start", before).select(
        key, "category", label.alias("label"), risk.alias("risk"), "value", masked.alias("masked"),
        (F.col("n") + 1).alias("line"), F.array("start", F.col("start") + F.length("value")).alias("span"),
        strip(F.col("line")).alias("context"),
    )


def precheck_stats(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def cleaning_report(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Totals of uncleaned data shapes over the corpus: ``advice, n``."""
    sums = df.agg(*[F.sum(c).cast("long").alias(name) for name, c in X.messy_counts(F.col(text)).items()])
    entries = F.array(*[F.struct(F.lit(n).alias("advice"), F.coalesce(n, F.lit(0)).alias("n")) for n in P.MESSY])
    return sums.select(F.explode(entries).alias("e")).select("e.*")


__all__ = ["cleaning_report", "find_kind", "merge_counts", "precheck", "precheck_stats", "scan_counts", "scan_independent"]
