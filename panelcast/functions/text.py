"""Text helpers: file-name slugs, lenient parsing and flag values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of a set flag, compared after trim and upper.
TRUE_WORDS = ("1", "YES", "Y", "TRUE")


def slug(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def unslug(path: Column, prefix: str, suffix: str) -> Column:
    """Series name back from a file name such as ``<prefix>new_york<suffix>``."""
    base = F.element_at(F.split(path, "/"), -1)
    base = F.regexp_replace(base, f"^{prefix}", "")
    base = F.regexp_replace(base, f"{suffix}$", "")
    return F.initcap(F.replace(base, F.lit("_"), F.lit(" ")))


def is_set(flag: Column) -> Column:
    return F.coalesce(F.upper(F.trim(flag.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def lenient_date(text: Column, fmt: str = "d/M/yyyy") -> Column:
    """Day-first date; text that does not fit the format becomes null."""
    return F.try_to_date(text, fmt)


def lenient_number(text: Column, default: float = 35.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))
