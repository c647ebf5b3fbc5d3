"""String expressions: stripping, alias keys, title case, initials."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabmend.functions import fixed


def strip(value: Column) -> Column:
    """Remove Unicode whitespace at both ends; a blank string becomes empty."""
    return F.btrim(value, F.lit(fixed.WHITESPACE))


def alias_key(value: Column) -> Column:
    """Letters and digits only, lower case: spellings with one key are variants."""
    return F.lower(F.regexp_replace(value, r"[^a-zA-Z0-9]", ""))


def is_title(value: Column) -> Column:
    """Every run of letters starts upper case and continues lower case."""
    return ~value.rlike(r"(?:^|[^\p{L}])\p{Ll}|\p{L}\p{Lu}")


def words(value: Column) -> Column:
    return F.filter(F.split(strip(value), r"[\s\p{Z}\x{85}_\-]+"), lambda w: w != "")


def initials(value: Column) -> Column:
    return F.upper(F.array_join(F.transform(words(value), lambda w: F.substring(w, 1, 1)), ""))
