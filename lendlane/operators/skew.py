"""Joins and rankings that stay distributed when one key holds much of the data.

Spark's adaptive execution splits a skewed side of a sort-merge join by itself, but only where
both join inputs come straight from a shuffle.  It cannot help where a table is joined back to
an aggregate of itself, nor inside a window.  The helpers here cover those two cases, the same
way for every key and every size:

* ``lookup_join`` / ``attach_aggregates`` join on one more key that is always equal, so that both
  sides are shuffled for the join itself and a hot key can be split;
* ``rank_rows`` numbers rows range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], row_id: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join ``facts`` to ``lookup``, which has at most one row per key.

    The join has one more key, 0 on both sides for equal keys.  Neither side is partitioned by it
    beforehand, so Spark shuffles both for this join, and adaptive execution can split a key
    with very many facts.  This needs ``spark.sql.requireAllClusterKeysForCoPartition`` and adaptive execution
    on, as by default; a literal would be optimized away.  Rows with a NULL key match nothing and are
    spread by a hash of ``row_id``, which names columns that tell fact rows apart.  ``how`` is
    ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join cannot do a {how} join")
    keys = list(keys)
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    # never NULL, to the optimizer too: else it would filter for that, with a copy of the keys' expressions
    even = F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(1).cast("bigint")), F.lit(0).cast("bigint"))
    spread_facts = facts.withColumn("_even", F.when(some_null, F.xxhash64(*row_id)).otherwise(even))
    return spread_facts.join(lookup.withColumn("_even", even), [*keys, "_even"], how).drop("_even")


def attach_aggregates(
    facts: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], row_id: Sequence[str]
) -> DataFrame:
    """Every row with its group's aggregates, as an unordered window would give.

    The aggregates combine map-side, so a hot group costs one row per task.
    Rows with a NULL key get NULL aggregates.
    """
    keys = list(keys)
    return lookup_join(facts, facts.groupBy(*keys).agg(*aggregates), keys, row_id)


def id_order(column: str | Column, descending: bool = False) -> Column:
    """A bigint id as an ordering value; NULL is first, or last where ``descending``."""
    value = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(-(2**62)))
    return F.bitwise_not(value) if descending else value  # ~x = -x-1: turns the order round, cannot overflow


def newest_first(micros: Column) -> Column:
    """Microseconds as an ordering value: newest first, NULL last."""
    return F.coalesce(F.bitwise_not(micros), F.lit(2**62))


def _bounds(df: DataFrame, order: Sequence[str], ranges: int) -> list[list[int]]:
    """Per ordering column its distinct quantiles over all rows, from one sketch that tasks merge.

    At most ``ranges`` numbers a column come to the driver, whatever the table holds.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(*[F.percentile_approx(o, shares, 4 * ranges).alias(o) for o in order]).first()
    return [sorted(set(quantiles or [])) for quantiles in found]


def _range_code(value: Column, bounds: list[int], ranges: int) -> Column:
    """Place of ``value`` among the bounds: even on one of them, odd between two.

    Some bounds, evenly apart, are looked at first, then those that follow the place found.
    """
    def numbers(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    if not bounds:
        return F.lit(1)
    fan = max(2, round(ranges**0.5))
    block = F.greatest(F.size(F.filter(numbers(bounds[::fan]), lambda b: b <= value)) - 1, F.lit(0)) * fan
    below = block + F.size(F.filter(F.slice(numbers(bounds), block + 1, F.lit(fan)), lambda b: b <= value))
    return below * 2 + F.when(F.array_contains(numbers(bounds), value), 0).otherwise(1)


def rank_rows(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str, ranges: int = 256
) -> DataFrame:
    """``row_number() over (partition by groups order by order)``, exact, for groups of any size.

    ``order`` are bigint columns without NULLs, ascending, that together tell a group's rows apart.
    Rows are numbered inside a range of the order, plus the number of rows of the group in earlier ranges.
    Ranges lie between quantiles of the whole table, and a value that fills a
    quantile is a range of its own, cut up by the next ordering value.  So a range holds about one row in ``ranges`` of
    the table at most, whatever the group, and a group has so many ranges that their sizes
    are few.  Bounds only shape the tasks: any bounds give the same numbers.  They are exact to 2**53;
    repeated values beyond, before the last ordering value, may share a range with their neighbours.
    Without ``groups`` the whole table is one group.
    """
    parts = [f"_o{i}" for i in range(len(order))]
    # a struct key makes NULL group values equal each other in the join below
    key = F.struct(*groups) if groups else F.lit(0)
    rows = df.withColumns({"_g": key, **dict(zip(parts, order))})
    code = [_range_code(F.col(p), bounds, ranges) for p, bounds in zip(parts, _bounds(rows, parts, ranges))]
    levels = [f"_c{i}" for i in range(len(parts))]
    for i, level in enumerate(levels):
        # cut up further only where the value before is a range of its own
        cut = F.lit(True) if i == 0 else (F.col(levels[i - 1]) >= 0) & (F.col(levels[i - 1]) % 2 == 0)
        rows = rows.withColumn(level, F.when(cut, code[i]).otherwise(F.lit(-1)))
    sizes = rows.groupBy("_g", *levels).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_g", *levels, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_g", *levels).orderBy(*parts))
    return (
        rows.withColumn("_inside", inside)
        .join(before, ["_g", *levels])
        .select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
    )
