"""What changed between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

DIGEST = 32


def _narrow(df: DataFrame, column: str, kind) -> Column:
    """A value that equals another one's just where the values are equal: texts and bytes of ``DIGEST`` bytes or more as a digest."""
    value = F.col(column).cast(kind)
    if kind.typeName() not in ("string", "binary"):
        return value
    raw = value.cast("binary")
    return F.when(F.octet_length(raw) < DIGEST, raw).otherwise(F.unhex(F.sha2(raw, 8 * DIGEST)))


def table_changes(old: DataFrame, new: DataFrame, key: str, ignored: Sequence[str] = ("updated_at",)) -> DataFrame:
    """``key, change, changed_columns`` of the rows that differ, ``changed_columns`` by their order in ``new``.

    ``change`` is ``inserted``, ``deleted`` or ``changed``; only the last names columns, joined by ``,``.  Columns
    of both versions count, but for the key and the ``ignored``, as the types ``new`` has; NULL
    equals NULL, as key too.  Keys are unique in a version: a key that occurs twice in one is an error.  Empty versions
    give all rows of the other.  Rows cross the network once, long texts as digests; map columns cannot be compared.

    Keys being unique, rows of a key are brought together before anything is aggregated: a task that reads a version holds none
    of it, and what a task sorts is its share of both versions.
    """
    watched = [c for c in new.columns if c in old.columns and c != key and c not in ignored]
    kinds = {c: new.schema[c].dataType for c in [key, *watched]}

    def version(df: DataFrame, is_new: bool) -> DataFrame:
        values = [_narrow(df, c, kinds[c]).alias(f"c{i}") for i, c in enumerate(watched)]
        return df.select(F.col(key).cast(kinds[key]).alias("_key"), F.lit(is_new).alias("_new"), F.struct(F.lit(1).alias("one"), *values).alias("_row"))

    found = version(old, False).unionAll(version(new, True)).repartition("_key").groupBy("_key").agg(
        F.count_if(~F.col("_new")).alias("_olds"), F.count_if(F.col("_new")).alias("_news"),
        F.first(F.when(~F.col("_new"), F.col("_row")), ignorenulls=True).alias("_before"),
        F.first(F.when(F.col("_new"), F.col("_row")), ignorenulls=True).alias("_after"),
    )
    differ = [
        F.when(~F.col(f"_before.c{i}").eqNullSafe(F.col(f"_after.c{i}")), F.lit(c)) for i, c in enumerate(watched)
    ]
    names = F.concat_ws(",", *differ) if differ else F.lit("")
    twice = F.raise_error(F.concat(F.lit("key twice in one version: "), F.coalesce(F.col("_key").cast("string"), F.lit("NULL"))))
    change = (
        F.when((F.col("_olds") > 1) | (F.col("_news") > 1), twice.cast("string"))
        .when(F.col("_olds") == 0, "inserted").when(F.col("_news") == 0, "deleted").when(F.col("_names") != "", "changed")
    )
    return (
        found.withColumn("_names", names).withColumn("change", change).where(F.col("change").isNotNull())
        .select(F.col("_key").alias(key), "change", F.when(F.col("change") == "changed", F.col("_names")).alias("changed_columns"))
    )
