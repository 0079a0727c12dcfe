"""Text expressions built from SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a pattern.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, even where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; no word for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all other letters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def gram_hashes(w: Column, k: int) -> Column:
    """64-bit hashes of all k consecutive words, in order."""
    n = F.size(w) - k
    return F.when(n < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))
