"""Mask, redact and preview expressions for one matched value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import patterns as P


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def keep_ends(value: Column, left: int, right: int) -> Column:
    """First ``left`` and last ``right`` characters, stars between."""
    return F.concat(
        F.substring(value, 1, left), stars(F.length(value) - (left + right)), F.substring(value, -right, right)
    )


def has_rare(value: Column) -> Column:
    """A rare ideograph or any character outside the common set."""
    return value.rlike(P.RARE_CJK) | value.rlike(P.UNCOMMON_CHAR)


def _first_and_last(value: Column) -> Column:
    n = F.length(value)
    return (
        F.when(has_rare(value) | (n <= 2), stars(n))
        .otherwise(F.concat(F.substring(value, 1, 1), stars(n - 2), F.substring(value, -1, 1)))
    )


def _person(value: Column) -> Column:
    words = F.filter(F.split(value, f"[{P.WS}]+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), stars(F.length(w) - 1))), " ")
    return (
        F.when(has_rare(value), stars(F.length(value)))
        .when(value.contains(" "), initials)
        .otherwise(F.concat(F.substring(value, 1, 1), stars(F.length(value) - 1)))
    )


def mask_expr(kind: str, value: Column) -> Column:
    """The reversible-by-mapping mask of ``value``, which was matched as ``kind``."""
    n = F.length(value)
    if kind in P.KEEP_RULES:
        size, left, right, exact = P.KEEP_RULES[kind]
        fits = (n == size) if exact else (n >= size)
        return F.when(fits, keep_ends(value, left, right)).otherwise(_first_and_last(value))
    if kind == "email":
        local = F.substring_index(value, "@", 1)
        domain = F.when(value.contains("@"), F.substr(value, F.length(local) + 2)).otherwise("")
        return F.concat(F.when(local == "", "x").otherwise(F.substring(local, 1, 1)), F.lit("***@"), domain)
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.when(F.size(parts) == 4, F.concat(parts[0], F.lit("."), parts[1], F.lit(".*.*"))).otherwise("*.**.**.*")
    if kind == "jwt":
        return F.when(
            n > 12, F.concat(F.substring(value, 1, 6), F.lit("***"), F.substring(value, -6, 6))
        ).otherwise(F.concat(F.substring(value, 1, 3), F.lit("***")))
    if kind == "intl_phone":
        digits = F.regexp_replace(value, rf"\P{{Nd}}", "")
        d = F.length(digits)
        return F.when(d >= 6, F.concat(F.lit("+"), stars(d - 4), F.substring(digits, -4, 4))).otherwise(
            F.concat(F.lit("+"), stars(F.greatest(d - 2, F.lit(1))))
        )
    if kind in ("name", "cn_name"):
        return _person(value)
    if kind in P.PLACEHOLDERS:
        return F.lit(P.PLACEHOLDERS[kind])
    return _first_and_last(value)


def redact_expr(kind: str) -> Column:
    return F.lit(f"[REDACTED_{kind.upper()}]")


def preview_mask(category: str, value: Column) -> Column:
    """The short preview shown beside a pre-check finding."""
    n = F.length(value)
    if category in ("phone", "bankcard", "idcard"):
        return F.when(n >= 6, keep_ends(value, 3, 3)).otherwise(stars(n))
    if category == "email":
        user = F.substring_index(value, "@", 1)
        rest = F.substr(value, F.length(user) + 2)
        shown = F.when(F.length(user) > 1, F.concat(F.substring(user, 1, 1), stars(F.length(user) - 1))).otherwise(user)
        return F.when(value.contains("@"), F.concat(shown, F.lit("@"), rest)).otherwise(stars(n))
    if category == "url":
        return F.concat(F.substring(value, 1, 12), F.lit("…(已省略)"))
    return F.when(n <= 1, F.lit("*")).otherwise(F.concat(F.substring(value, 1, 1), stars(n - 1)))
