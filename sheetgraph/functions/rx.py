"""Regular expressions whose word boundaries are ASCII, as the rules here were written for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_]"
#: Java's \b follows Unicode letters: next to an accented letter it finds no boundary.
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def ascii_boundaries(pattern: str) -> str:
    return pattern.replace(r"\b", _BOUNDARY)


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(("(?i)" if ignore_case else "") + ascii_boundaries(pattern))


def first_of(col: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The name of the first rule (name, pattern) that col matches."""
    out = None
    for name, pattern in rules:
        test = matches(col, pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))
