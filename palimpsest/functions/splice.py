"""Regex replacement where the replacement is an arbitrary column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Replacer = Callable[[Column, Column], Column]


def pattern(pat: str | Column) -> Column:
    return F.lit(pat) if isinstance(pat, str) else pat


def matches(text: Column, pat: str | Column, group: int = 0) -> Column:
    """All matches of ``pat`` as ``array<string>``."""
    return F.regexp_extract_all(text, pattern(pat), F.lit(group))


def weave(text: Column, pat: str | Column, replacements: Column) -> Column:
    """Put ``replacements[i]`` where the i-th match of ``pat`` stood.

    ``split`` returns one gap more than there are matches, so zipping gaps with
    replacements and concatenating rebuilds the text in one pass.
    """
    gaps = F.split(text, pattern(pat), -1)
    pieces = F.zip_with(gaps, replacements, lambda gap, repl: F.concat(gap, F.coalesce(repl, F.lit(""))))
    return F.array_join(pieces, "")


def splice(text: Column, pat: str | Column, replace: Replacer) -> Column:
    """Replace every match of ``pat`` by ``replace(match, position)``."""
    return weave(text, pat, F.transform(matches(text, pat), replace))


def quote(value: Column) -> Column:
    """A pattern that matches ``value`` literally."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def any_of(keys: Column) -> Column:
    """Alternation of literal keys, longest first, as a row-dynamic pattern."""
    longest_first = F.transform(
        F.sort_array(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))),
        lambda s: quote(s["k"]),
    )
    return F.array_join(longest_first, "|")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
