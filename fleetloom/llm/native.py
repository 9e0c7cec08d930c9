"""Column expressions that the native operators share: words and their hashes as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import SPACE


def words(text: str | Column) -> Column:
    """The words of a whole text; null and empty: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes(array: str) -> Column:
    """The 64-bit hash of each word."""
    return F.expr(f"transform({array}, w -> xxhash64(w))")


def shingles(array: str, k: int) -> Column:
    """Hashes of k neighbours in an array column of hashes; shorter arrays have none."""
    ahead = "".join(f", get({array}, i + {j})" for j in range(1, k))
    return F.expr(f"transform(slice({array}, 1, greatest(size({array}) - {k - 1}, 0)), (x, i) -> xxhash64(x{ahead}))")


def longer(grams: str, array: str, k: int) -> Column:
    """Hashes of k neighbours, from an array column with those of k - 1 and one with those of one."""
    n = f"greatest(size({array}) - {k - 1}, 0)"
    return F.expr(f"zip_with(slice({grams}, 1, {n}), slice({array}, {k}, {n}), (a, b) -> xxhash64(a, b))")
