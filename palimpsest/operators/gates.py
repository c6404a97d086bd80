"""Decisions about what may leave: outbound gate, deliverable gate, session leak check."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.operators import deident

# --- fixed values: deliverable kinds -----------------------------------------
TEXT_DELIVERABLE = (".md", ".txt", ".csv")
BINARY_DELIVERABLE = (".png", ".jpg", ".jpeg", ".pdf")


def scan_summary(passed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_hits, tier`` for every scanned document (tier null where clean).  Map-only."""
    high = F.exists("hits", lambda h: h["kind"].isin(*P.HIGH_RISK))
    tier = F.when(high, P.TIER_HIGH).when(F.size("hits") > 0, P.TIER_MEDIUM)
    return passed.select(key, F.size("hits").cast("long").alias("n_hits"), tier.alias("tier"))


def outbound_gate(scans: DataFrame, *, explicit: Column, confirmed: Column, scan_ok: Column | None = None,
                  scanner_installed: Column | None = None) -> DataFrame:
    """``allow`` and ``card`` (wording) per outgoing text.

    Clean passes silently; a hit needs confirmation; a failed scan blocks unless
    confirmed; a missing scanner reminds on implicit sends only.
    """
    ok = F.lit(True) if scan_ok is None else scan_ok
    present = F.lit(True) if scanner_installed is None else scanner_installed
    clean = ok & (F.col("n_hits") == 0)
    card = (
        F.when(~present, F.when(explicit, "").otherwise("not_scanned"))
        .when(clean, "").when(explicit, "explicit")
        .when(F.col("tier") == P.TIER_HIGH, "implicit_high").otherwise("implicit_consent")
    )
    return scans.withColumns({
        "allow": ~present | clean | confirmed, "card": card,
        "audit_required": present & ~clean & confirmed,
    })


def deliverable_gate(files: DataFrame, by: Iterable[str], *, ext: str = "ext", n_hits: str = "n_hits",
                     scanned: str = "scanned") -> DataFrame:
    """Per section: clean, blocked, and whether pictures need a human look.

    ``files`` holds one row per deliverable with its hit count and whether the
    scan gave an answer; no answer counts as a hit.
    """
    text = F.col(ext).isin(*TEXT_DELIVERABLE)
    bad = text & (~F.col(scanned) | (F.col(n_hits) > 0))
    binary = F.col(ext).isin(*BINARY_DELIVERABLE)
    return files.groupBy(*by).agg(
        F.count_if(text).cast("long").alias("n_text"), F.count_if(binary).cast("long").alias("n_binary"),
        F.count_if(bad).cast("long").alias("n_blocked"),
    ).withColumns({
        "clean": F.col("n_blocked") == 0, "manual_required": F.col("n_binary") > 0,
        "decision": F.when(F.col("n_blocked") > 0, "block").when(F.col("n_text") + F.col("n_binary") == 0, "nothing")
        .otherwise("allow"),
    })


def _any(low: Column, words: Iterable[str]) -> Column:
    return reduce(or_, (low.contains(w.lower()) for w in words))


def leak_flags(text: Column) -> dict[str, Column]:
    """What one turn of a session contributes to the leak check."""
    low = F.lower(text)
    return {
        "outbound": _any(low, P.OUTBOUND_HINTS), "recognition": _any(low, P.RECOGNITION_HINTS),
        "send": _any(low, P.SEND_VERBS), "trace": _any(low, P.TRACE_HINTS),
    }


def session_leaks(turns: DataFrame, *, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Sessions with an outgoing action and no trace of de-identification.

    Four flags per turn, or-ed map-side: a hot session ships one row per task.
    """
    flags = turns.select(key, *[c.alias(n) for n, c in leak_flags(F.col(text)).items()])
    per = flags.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in ("outbound", "recognition", "send", "trace")])
    out = F.col("outbound") | (F.col("recognition") & F.col("send"))
    return per.select(key, out.alias("has_outbound"), "trace", (out & ~F.col("trace")).alias("leak"))


def audit_entry(ts: Column, target: Column, decision: Column, *, risk: Column | None = None, hits: Column | None = None,
                copy: Column | None = None, mapping: Column | None = None, reviewer: Column | None = None,
                note: Column | None = None) -> list[Column]:
    """The columns of one append-only audit row (missing ones become '')."""
    parts = {"risk": risk, "hits": hits, "copy": copy, "mapping": mapping, "reviewer": reviewer, "note": note}
    return [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), target.alias("target"), decision.alias("decision"),
        *[F.coalesce(c, F.lit("")).alias(n) if c is not None else F.lit("").alias(n) for n, c in parts.items()],
    ]


def gate_documents(df: DataFrame, *, key: str = "doc_id", explicit: Column | None = None,
                   confirmed: Column | None = None, **options) -> DataFrame:
    """Scan and decide in one map-only pass."""
    scans = scan_summary(deident.scan_pass(df, "mask", **options), key)
    return outbound_gate(scans, explicit=F.lit(False) if explicit is None else explicit,
                         confirmed=F.lit(False) if confirmed is None else confirmed)
