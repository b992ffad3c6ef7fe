"""Column expressions shared by the operators. All of them stay inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_array(values, to: str = "int") -> Column:
    """A constant array, passed to the plan as one literal."""
    values = list(values)
    if not values:
        return F.array().cast(f"array<{to}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{to}>")


def half_even(value: Column, to: str) -> Column:
    """Cast to an integer type, rounding halves to the even neighbour instead of truncating."""
    return F.rint(value).cast(to)


def seeded_digest(key: str, seed: int) -> Column:
    """Hex digest of `seed:key`; a stable pseudo-random order that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col(key).cast("string")))


def hash_bucket(key: str, seed: int, buckets: int) -> Column:
    """Bucket 0..buckets-1 from the first 32 bits of the seeded digest."""
    head = F.conv(F.substring(seeded_digest(key, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets).cast("bigint"))


def price_to_double(price: Column) -> Column:
    """"$1,299.00" -> 1299.0; "None", blanks and other text -> null."""
    bare = F.regexp_replace(price.cast("string"), "[$,]", "")
    return F.nullif(bare, F.lit("None")).try_cast("double")


def date_of(ts: Column) -> Column:
    """UTC date of unix seconds, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(ts / 86_400).cast("int"))


def day_of(ts: Column) -> Column:
    return date_of(ts).cast("string")


def year_of(ts: Column) -> Column:
    return F.year(date_of(ts))


def seconds_of(ts: Column) -> Column:
    """Unix seconds of a zone-less timestamp read as UTC, whatever the session's zone."""
    return (F.unix_date(ts.cast("date")).cast("bigint") * 86_400
            + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts))
