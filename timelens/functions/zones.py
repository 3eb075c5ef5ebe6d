"""Where a time zone changes its offset, as expressions that look it up in constant time."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instants outside these years count as near a change.
FIRST_YEAR, LAST_YEAR = 1900, 2200
#: Time is cut into blocks of this many seconds, some 24 days.
BLOCK = 1 << 21
_NEVER = 1 << 62
_YEAR = 31_556_952


@lru_cache(maxsize=32)
def transitions(zone: str) -> tuple[int, ...]:
    """Epoch seconds of all changes of the zone's offset, by the rules that Spark uses."""
    time = SparkContext.getOrCreate()._jvm.java.time
    rules = time.ZoneId.of(zone, time.ZoneId.SHORT_IDS).getRules()
    first, last = ((year - 1970) * _YEAR for year in (FIRST_YEAR, LAST_YEAR))
    found, at = [], rules.nextTransition(time.Instant.ofEpochSecond(first))
    while at is not None and at.toEpochSecond() < last:
        found.append(int(at.toEpochSecond()))
        at = rules.nextTransition(at.getInstant())
    return tuple(found)


def _blocks(changes: tuple[int, ...]) -> tuple[int, list[int], list[int]]:
    """The first block, and for every block the first two changes from its start on."""
    first, last = (((year - 1970) * _YEAR) // BLOCK for year in (FIRST_YEAR, LAST_YEAR))
    nearest, following, i = [], [], 0
    for block in range(first, last):
        while i < len(changes) and changes[i] < block * BLOCK:
            i += 1
        after = [*changes[i : i + 2], _NEVER, _NEVER]
        nearest.append(after[0])
        following.append(after[1])
    return first, nearest, following


def keeps_offset(lower: Column, upper: Column, zone: str) -> Column:
    """True when the zone has the same offset all the time between two instants.

    Two look-ups in constant arrays by the block of the first instant. Where a block
    has two changes before that instant, or it is outside the known years, the answer
    is false although it may be true; callers then go the exact way.
    """
    first, nearest, following = _blocks(transitions(zone))
    low, high = F.floor(lower.cast("double")), F.ceil(upper.cast("double"))
    place = F.floor(low / BLOCK) - first
    known = (place >= 0) & (place < len(nearest))

    def looked_up(values: list[int]) -> Column:
        # One constant to Spark, which it takes apart once, instead of one for each value.
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), place.cast("int"))

    next_change = F.when(low < looked_up(nearest), looked_up(nearest)).when(
        low < looked_up(following), looked_up(following)
    )
    return F.coalesce(known & (next_change > high), F.lit(False))
