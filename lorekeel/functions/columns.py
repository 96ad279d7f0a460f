"""Column expressions shared by the operators; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"(?U)\s+"


def nocase(c: Column | str) -> Column:
    """The form in which names are compared without case, for all of Unicode."""
    return F.lower(F.col(c) if isinstance(c, str) else c)


def hex_id(c: Column | str) -> Column:
    """Document ids with and without dashes are one."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "-", "")


def content_hash(body: Column) -> Column:
    """SHA-256 of the lower-cased body with white space collapsed; NULL for NULL."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(body), _SPACES, " ")), 256)


def budget_tokens(text: Column) -> Column:
    """The prompt budget's estimate: a token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def word_tokens(text: Column) -> Column:
    """The segmenters' estimate: words between white space; 0 for blank text."""
    t = F.trim(F.regexp_replace(text, _SPACES, " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("int")


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def unset_or(c: str, cond: Column) -> Column:
    return F.col(c).isNull() | cond


def partial_date(text: Column) -> Column:
    """2024-03-05, 2024-03 and 2024 as timestamps; NULL for anything else."""
    t = F.trim(text)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M-d"))),
        F.when(t.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M"))),
        F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(t, F.lit("yyyy"))),
    )


def clamp(x: Column) -> Column:
    """A confidence within [0, 1]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def snippet(text: Column, start: Column, end: Column, window: int = 100) -> Column:
    """The text around [start, end) with ``window`` characters on either side, cut at blanks, with ... where it was cut.

    Offsets count characters from 0.
    """
    n = F.length(text)
    a = F.greatest(F.lit(0), start - window)
    b = F.least(n, end + window)
    blank = F.instr(F.substring(text, a + 1, n), " ") + a - 1  # 0-based, or a - 1 if there is none
    left = F.when((a > 0) & (blank >= a) & (blank < start), blank + 1).otherwise(a)
    tail = F.reverse(F.substring(text, end + 1, b - end))
    back = F.instr(tail, " ")  # from the right
    right = F.when((b < n) & (back > 0), b - back).otherwise(b)
    cut = F.substring(text, left + 1, right - left)
    return F.concat(F.when(left > 0, "...").otherwise(""), cut, F.when(right < n, "...").otherwise(""))


def overlapping_count(text: Column, needle: Column) -> Column:
    """How often ``needle`` occurs in ``text``, overlaps included; 0 for an empty needle."""
    pattern = F.concat(F.lit(r"(?=\Q"), F.regexp_replace(needle, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E)"))
    return F.when(needle == "", 0).otherwise(F.regexp_count(text, pattern))


def ambiguity(entities: Column, proposals: Column, valid: Column) -> Column:
    """How unsure a response is: 1 where it is invalid or empty, else the share of new proposals."""
    return F.when(~valid | (entities <= 0), 1.0).otherwise(proposals / entities)


def words_joined(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACES, " "))
