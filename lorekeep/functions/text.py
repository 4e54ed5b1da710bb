"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(value: str | None) -> bool:
    """Whether a filter argument means "no filter": null, empty or white space alone."""
    return value is None or not value or value.isspace()


def has_text(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def has_words(c: Column) -> Column:
    """Neither null nor white space alone."""
    return ~F.coalesce(c, F.lit("")).rlike(r"^\s*$")


#: The one letter that lower-casing expands; it keeps to itself under a private code point.
EXPANDING, OWN = "İ", "\ue130"


def folded(c: Column) -> Column:
    """Lower case letter by letter: nothing expands, and both small sigmas are one. Far faster than comparing under a collation."""
    return F.translate(F.lower(F.translate(c, EXPANDING, OWN)), "ς", "σ")


def contains_any(columns: list[Column], needle: str) -> Column:
    """Case-insensitive substring of any of the columns; % and _ are ordinary; an empty needle is in every text."""
    hit = [F.contains(folded(F.coalesce(c, F.lit(""))), folded(F.lit(needle))) for c in columns]
    return reduce(lambda a, b: a | b, hit)


def shortened(c: Column, most: int = 25) -> Column:
    """Text of more than `most` characters cut to that length, ending in three dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def band(c: Column, limits: list[tuple[int, str]], rest: str) -> Column:
    """The name of the first limit that the value reaches."""
    out = None
    for least, name in limits:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise(rest)


# fixed values: colours of priorities and severities
PRIORITY_BANDS = [(8, "error"), (5, "warning"), (3, "info")]
SEVERITY_COLOURS = {"Never": "error", "StronglyAvoid": "warning"}


def severity_colour(c: Column) -> Column:
    return F.when(c == "Never", SEVERITY_COLOURS["Never"]).when(c == "StronglyAvoid", SEVERITY_COLOURS["StronglyAvoid"]).otherwise("info")


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    """The rank of a name; null of an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), c)


def parse_name(value: str, names: dict[str, int]) -> str:
    """The name that equals the value in any case; ValueError for others."""
    for n in names:
        if n.lower() == value.strip().lower():
            return n
    raise ValueError(f"{value!r} is none of {', '.join(names)}")
