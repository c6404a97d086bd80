"""Detectors as column expressions over one text column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P
from palimpsest.functions.splice import matches



def empty_strings() -> Column:
    return F.array().cast("array<string>")


_FULL = "".join(chr(c) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)) + " "


def normalize(text: Column) -> Column:
    """Full-width digits, letters and the ideographic space become half-width."""
    # ranges, because a class of sixty separate characters is slow to test
    return F.when(text.rlike("[０-９Ａ-Ｚａ-ｚ　]"), F.translate(text, _FULL, _HALF)).otherwise(text)


def iban_ok(value: Column) -> Column:
    """Length 15..34 and ISO 7064 remainder 1, folded digit by digit."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))
    remainder = F.aggregate(
        matches(moved, "."),
        F.lit(0),
        lambda acc, c: F.pmod(
            F.when(F.ascii(c) >= 65, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48), F.lit(97)
        ),
    )
    return F.length(value).between(15, 34) & value.rlike(rf"^[A-Z]{{2}}{P.D}{{2}}[A-Z0-9]+$") & (remainder == 1)


def is_valid(kind: str, value: Column) -> Column | None:
    """The check a match of ``kind`` must pass, or None where there is none."""
    if kind == "iban":
        return iban_ok(value)
    if kind == "swift":
        return F.substring(value, 5, 2).isin(*P.country_codes())
    if kind == "vat":
        return F.substring(value, 1, 2).isin(*P.VAT_PREFIXES)
    return None


def worth_trying(kind: str, text: Column) -> Column:
    """Cheap necessary condition for a hit."""
    if kind in P.KIND_SUBSTRINGS:
        return reduce(or_, (text.contains(s) for s in P.KIND_SUBSTRINGS[kind]))
    if kind in P.KIND_HINTS:
        return text.rlike(P.KIND_HINTS[kind])
    return F.lit(True)


def find(kind: str, text: Column, pat: str | None = None) -> Column:
    """All valid matches of ``kind`` in ``text``."""
    found = matches(text, pat or P.KINDS[kind])
    if is_valid(kind, F.lit("")) is not None:
        found = F.filter(found, lambda v: is_valid(kind, v))
    return F.when(worth_trying(kind, text), found).otherwise(empty_strings())


def count(kind: str, text: Column) -> Column:
    if kind in ("iban", "swift", "vat"):
        return F.size(find(kind, text))
    return F.when(worth_trying(kind, text), F.regexp_count(text, F.lit(P.KINDS[kind]))).otherwise(0)


def secrets(text: Column) -> Column:
    """Values assigned to secret-looking keys (still quoted where they were)."""
    return F.when(
        text.rlike(r"(?i)key|secret|token|passw|auth"), matches(text, P.SECRET, P.SECRET_VALUE_GROUP)
    ).otherwise(empty_strings())


def unquote(value: Column) -> Column:
    """Drop one pair of equal quotes around ``value``."""
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    wrapped = (F.length(value) >= 2) & first.isin("'", '"') & (first == last)
    return F.when(wrapped, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{P.WS}]+|[{P.WS}]+$", "")


def sql_secrets(text: Column) -> Column:
    """``array<struct<quoted, inner>>`` of values INSERTed into secret-looking columns."""
    statements = F.arrays_zip(
        matches(text, P.SQL_INSERT, 1).alias("cols"), matches(text, P.SQL_INSERT, 2).alias("vals")
    )

    def fields(values: Column) -> Column:
        cells = F.split(values, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        return F.transform(
            cells,
            lambda c: _strip(
                F.when(c.rlike('^".*"$'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))
                .otherwise(c)
            ),
        )

    def picked(st: Column) -> Column:
        names = F.transform(F.split(st["cols"], ","), lambda c: F.btrim(_strip(c), F.lit('`"[]')))
        pairs = F.arrays_zip(names.alias("c"), fields(st["vals"]).alias("v"))
        good = F.filter(
            pairs, lambda p: p["c"].rlike(P.SQL_SECRET_COLUMN) & p["v"].isNotNull() & (F.length(p["v"]) >= 4)
        )
        return F.filter(
            F.transform(good, lambda p: F.struct(p["v"].alias("quoted"), unquote(p["v"]).alias("inner"))),
            lambda s: s["inner"] != "",
        )

    kept = F.filter(statements, lambda s: F.coalesce(s["cols"], F.lit("")) != "")
    return F.when(text.rlike(r"(?i)insert\s+into"), F.flatten(F.transform(kept, picked))).otherwise(
        F.array().cast("array<struct<quoted:string,inner:string>>")
    )


def messy_counts(text: Column) -> dict[str, Column]:
    """How often each kind of uncleaned data occurs (advice only, nothing is masked)."""
    return {name: F.regexp_count(text, F.lit(p)) for name, p in P.MESSY.items()}


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def account_platform(url: Column) -> Column:
    """First platform whose account, channel or playlist marker occurs in the URL."""
    low = F.lower(F.coalesce(url, F.lit("")))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for platform, marks in P.ACCOUNT_PATTERNS.items():
        chain = chain.when(reduce(or_, (low.contains(m) for m in marks)), F.lit(platform))
    return chain


def failure_class(message: Column) -> tuple[Column, Column]:
    """(looks like DRM, looks like a missing login)."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        reduce(or_, (low.contains(w) for w in P.DRM_WORDS)),
        reduce(or_, (low.contains(w) for w in P.LOGIN_WORDS)),
    )
