"""Joins of many rows with facts about their keys, where one key may hold a third of all rows, and filters that keep
rows from being shuffled for nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows. There can be no more hot keys than that, whatever the data.
HOTS = 4096
#: Bits of a filter: so many for each key, but no more than 2^28 (32 MB) and no fewer than 2^20 in all.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 20, 28
_WORD = 32768  # bits of one bitmap


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, one for each key, whose column ``n`` says how many rows the key has, of ``total`` at least.

    Facts about hot keys, HOTS at most, are broadcast, so the rows of a hot key stay where they are; the rest is merged, and no
    key of the rest has more than one in HOTS of all rows. ``facts`` should be a written table, as it is read twice."""
    hot = F.col(n) * F.lit(HOTS) > F.lit(total)
    few = facts.filter(hot)
    spread = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(facts.filter(~hot).hint("merge"), on, how)
    return rows.join(F.broadcast(few), on).unionByName(spread)


def _place(key: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit("filter")), F.lit(1 << bits))


def maybe_among(rows: DataFrame, keys: DataFrame, key: list[str], n: int) -> DataFrame:
    """``rows`` with ``__maybe``: false only where the row's key is not among the ``n`` rows of ``keys``.

    One hashed bit a key, in bitmaps of bounded size that are broadcast; with more keys than the bits can tell apart the filter
    lets more pass, and nothing else changes."""
    bits = min(MOST_BITS, max(LEAST_BITS, (max(1, n) * BITS_A_KEY - 1).bit_length()))
    place = _place(key, bits)
    maps = keys.select(F.shiftright(place, 15).alias("__map"), place.bitwiseAND(_WORD - 1).alias("__bit"))
    maps = maps.groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    placed = rows.withColumn("__place", place).withColumn("__map", F.shiftright("__place", 15))
    byte = F.expr("cast(conv(hex(substring(__bits, cast((__place & 32767) div 8 + 1 as int), 1)), 16, 10) as int)")
    hit = F.expr("shiftright(__byte, cast(__place & 7 as int)) & 1 = 1")
    joined = placed.join(F.broadcast(maps), "__map", "left").withColumn("__byte", byte)
    return joined.withColumn("__maybe", F.coalesce(hit, F.lit(False))).select(*rows.columns, "__maybe")
