"""Classes of characters, counted over many texts at once."""

from __future__ import annotations

import unicodedata

import numpy as np

OTHER, LOWER, UPPER, LETTER, DIGIT, BLANK, MARK = range(7)
_classes: np.ndarray | None = None


def _class_of(c: str) -> int:
    if c.isspace():
        return BLANK
    if c.isalpha():
        return UPPER if c.isupper() else LOWER if c.islower() else LETTER
    if c.isdigit():
        return DIGIT
    return MARK if unicodedata.category(c)[0] in "PS" else OTHER


def classes() -> np.ndarray:
    """The class of each code point of the basic plane."""
    global _classes
    if _classes is None:
        _classes = np.fromiter((_class_of(chr(i)) for i in range(0x10000)), np.uint8, 0x10000)
    return _classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each [start, end)."""
    seen = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=seen[1:])
    return seen[ends] - seen[starts]
