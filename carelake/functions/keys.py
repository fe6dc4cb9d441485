"""Keys derived from content, so that every run and every retry gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate(*parts: Column | str) -> Column:
    """64-bit key of a natural key.

    ``xxhash64`` skips NULLs, so each part is preceded by its NULL flag; otherwise
    ('a', NULL) and (NULL, 'a') would share a key.
    """
    flagged: list[Column] = []
    for part in parts:
        c = F.col(part) if isinstance(part, str) else part
        flagged += [c.isNull(), c]
    return F.xxhash64(*flagged)


def patient_key(first: Column | str, last: Column | str, birth: Column | str, salt: str = "") -> Column:
    """md5 of the lower-cased natural key, NULL counted as empty.

    The key is guessable from name and birth date; a ``salt`` prevents that.
    """

    def part(c: Column | str) -> Column:
        return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))

    joined = F.concat(part(first), F.lit("|"), part(last), F.lit("|"), part(birth))
    return F.md5(F.concat(F.lit(salt), F.lower(joined)))


def hashed_name(c: Column | str, salt: str = "") -> Column:
    name = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(F.lit(salt), name))
