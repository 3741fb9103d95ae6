"""Deterministic pseudo-random choices from md5, equal on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str | Column, *keys: Column | str) -> Column:
    """Hex md5 of 'seed:key[:key...]'; sorting by it is a fixed shuffle of the rows."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [head.cast("string")]
    for k in keys:
        parts.append((F.col(k) if isinstance(k, str) else k).cast("string"))
    return F.md5(F.concat_ws(":", *parts))


def draw(seed: int | str | Column, *keys: Column | str) -> Column:
    """A 32-bit integer in [0, 2^32) drawn from the first eight hex digits."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str | Column, *keys: Column | str) -> Column:
    """A number in [0, 1)."""
    return draw(seed, *keys) / F.lit(4294967296.0)


def bucket(hexdigest: Column, digits: int = 3) -> Column:
    """Leading hex digits: an order-preserving bucket of about equal size for any digest."""
    return F.substring(hexdigest, 1, digits)
