"""When listings are free, over an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lendlane.functions.columns import epoch_micros, lower_or_empty, moment
from lendlane.operators.feed import RENTING_STATES


def free_spans(trailers: DataFrame, bookings: DataFrame, since, until, slice_minutes: int = 60) -> DataFrame:
    """``trailer_id, free_from, free_until``: the longest spans in ``[since, until)`` without a rental.

    Rentals are half-open and in a renting state; those that end no later than they start take no time,
    and those of unknown listings do not count.  A listing without rentals is free all the time.

    A sweep: a rental counts +1 where it starts and -1 where it ends, and a listing is free where the sum is 0.
    Equal moments of a listing are added up before the shuffle.  Sums run inside slices of ``slice_minutes``, plus what
    earlier slices carry over, so that a listing with very many rentals is swept by many tasks; the
    carried sums are one row a slice.
    """
    low, high = (moment(m, bookings, "start_at") for m in (since, until))
    rentals = bookings.where(
        F.col("trailer_id").isNotNull() & lower_or_empty("status").isin(RENTING_STATES)
        & (F.col("start_at") < high) & (F.col("end_at") > low) & (F.col("start_at") < F.col("end_at"))
    )
    ends = F.array(
        F.struct(F.greatest("start_at", low).alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("end_at").alias("at"), F.lit(-1).alias("step")),
    )
    steps = rentals.select("trailer_id", F.inline(ends)).where(F.col("at") < high).withColumn("listed", F.lit(False))
    listed = trailers.select(F.col("id").alias("trailer_id"), low.alias("at"), F.lit(0).alias("step"), F.lit(True).alias("listed"))
    points = steps.unionByName(listed).groupBy("trailer_id", "at").agg(F.sum("step").alias("step"), F.max("listed").alias("listed"))
    points = points.withColumn("_slice", F.floor(epoch_micros(points, "at") / F.lit(slice_minutes * 60_000_000)))

    listing = Window.partitionBy("trailer_id")
    along = listing.orderBy("_slice")
    slices = points.groupBy("trailer_id", "_slice").agg(
        F.sum("step").alias("_net"), F.min("at").alias("_first"), F.max("listed").alias("_listed"))
    carried = slices.select(
        "trailer_id", "_slice", F.max("_listed").over(listing).alias("_known"), F.lead("_first").over(along).alias("_later"),
        F.coalesce(F.sum("_net").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"),
    ).where("_known")
    inside = Window.partitionBy("trailer_id", "_slice").orderBy("at")
    swept = points.select(
        "trailer_id", "_slice", "at", F.lead("at").over(inside).alias("_next"),
        F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    # after a moment with no rental, the next moment can only be a start
    return swept.join(carried, ["trailer_id", "_slice"]).where(F.col("_carried") + F.col("_sum") == 0).select(
        "trailer_id", F.col("at").alias("free_from"), F.coalesce("_next", "_later", high).alias("free_until"))
