"""Matches of a pattern with their places, as array columns: what comes before and after a match, and which matches share characters."""

from __future__ import annotations

from pyspark.sql import functions as F

#: A word's ends: no letter, digit or underscore of any script on the other side.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Nothing but white space of any script, or nothing at all, before.
APART = r"(?<![^\s\x85\p{Z}])"


def matches(col, pattern: str, group: int = 0):
    """array<struct<start, end, text, part>>: all matches in order, offsets in characters from 0, ``part`` the group's text.

    Places come from the pieces between the matches: a match starts after all pieces up to it and all matches before it.
    """
    text = F.coalesce(col, F.lit(""))
    found, parts = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    bound = F.struct(found.alias("found"), parts.alias("parts"), F.split(text, pattern, -1).alias("gaps"))

    def ends(x):
        sizes = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda gap, m: F.length(gap) + F.length(m))
        return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))

    def spans(x):
        told = lambda m, i: F.struct((F.get(x["ends"], i) - F.length(m)).alias("start"), F.get(x["ends"], i).alias("end"), m.alias("text"), F.get(x["parts"], i).alias("part"))
        return F.transform(x["found"], told)

    # Bound, since the lambdas would search the text again for each match.
    return let(let(bound, lambda x: F.struct(x["found"].alias("found"), x["parts"].alias("parts"), ends(x).alias("ends"))), spans)


def around(col, span, size: int):
    """The text from ``size`` characters before a match to as many after it."""
    first = F.greatest(span["start"] - size, F.lit(0))
    return F.substr(F.coalesce(col, F.lit("")), first + 1, span["end"] + size - first)


def overlaps(span, others):
    """Whether a match shares a character with one of ``others``."""
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def number(col):
    """A decimal number with a point or a comma."""
    return F.replace(col, F.lit(","), F.lit(".")).cast("double")


def let(value, f):
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
