"""The skew helpers must give what a plain join or window gives."""

import random

from pyspark.sql import Window, functions as F

from lendlane.functions.columns import epoch_micros
from lendlane.operators.skew import attach_aggregates, id_order, lookup_join, newest_first, rank_rows


def facts(frame):
    rows = [(i, 1 if i % 3 == 0 else i % 40, f"v{i}") for i in range(600)]
    rows += [(600 + i, None, "null key") for i in range(50)]
    return frame("id bigint, k bigint, v string", *rows)


def same(left, right):
    return sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.collect()), key=str)


def test_lookup_join_equals_plain_join(frame):
    f = facts(frame)
    lookup = frame("k bigint, w string", *[(i, f"w{i}") for i in range(0, 60, 2)], (1, "w1"), (None, "never"))
    for how in ("left", "inner"):
        joined = lookup_join(f, lookup, ["k"], ["id"], how)
        assert same(joined.select("id", "k", "v", "w"), f.join(lookup, "k", how).select("id", "k", "v", "w"))


def test_attach_aggregates_equals_window(frame):
    f = facts(frame)
    got = attach_aggregates(f, ["k"], [F.max("id").alias("top"), F.count(F.lit(1)).alias("n")], ["id"])
    w = Window.partitionBy("k")
    want = f.select("id", "k", "v", F.max("id").over(w).alias("top"), F.count(F.lit(1)).over(w).alias("n"))
    assert same(got.where("k is not null").select("id", "k", "v", "top", "n"), want.where("k is not null"))
    assert got.where("k is null and top is null").count() == 50


def test_rank_rows_equals_row_number(frame):
    rng = random.Random(7)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(300)} | set(range(2**20 - 50, 2**20 + 50)))
    rows = [(i, rng.choice(["hot", "hot", "a", None])) for i in ids]
    df = frame("id bigint, g string", *rows)
    got = rank_rows(df, ["g"], [id_order("id")], "rn", ranges=8)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert same(got.select("id", "g", "rn"), want)


def test_rank_rows_without_groups_and_descending(frame):
    df = frame("id bigint", *[(i * 700_001,) for i in range(-100, 100)])
    up = rank_rows(df, [], [id_order("id")], "rn")
    assert sorted((r.rn, r.id) for r in up.collect()) == [(n + 1, (n - 100) * 700_001) for n in range(200)]
    down = rank_rows(df, [], [id_order("id", descending=True)], "rn")
    assert [r.id for r in down.orderBy("rn").collect()] == [i * 700_001 for i in range(99, -101, -1)]


def test_newest_come_first_and_null_last(frame):
    moments = ["2020-01-01 00:00:00.000001", "2020-01-01 00:00:00.000002", "1969-05-05 10:00:00", "2024-06-01 00:00:00", None]
    df = frame("id bigint, t timestamp_ntz", *[(i, m) for i, m in enumerate(moments * 3)])
    order = [F.col("t").desc_nulls_last(), F.col("id").desc()]
    got = rank_rows(df, [], [newest_first(epoch_micros(df, "t")), id_order("id", descending=True)], "rn", ranges=4)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    assert same(got.select("id", "t", "rn"), want)


def test_ranges_stay_small_in_a_hot_group_and_on_repeated_values(spark):
    """One group with a third of the rows and one moment on most of them: no task gets a large share."""
    rows = spark.range(30_000).selectExpr(
        "id", "if(id % 3 = 0, 0L, if(id % 7 = 0, null, id % 500)) as g", "if(id % 10 < 8, 7L, id * 13 % 9000) as t")
    got = rank_rows(rows, ["g"], [F.col("t"), id_order("id", descending=True)], "rn", ranges=64)
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", F.col("id").desc())))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    largest = _ranges(rows, 64).groupBy("g", "_c0", "_c1").count().agg(F.max("count")).first()[0]
    assert largest < 30_000 / 64 * 1.5


def _ranges(rows, ranges):
    from lendlane.operators.skew import _bounds, _range_code

    keyed = rows.withColumns({"_o0": F.col("t"), "_o1": id_order("id", descending=True)})
    moments, ids = _bounds(keyed, ["_o0", "_o1"], ranges)
    first = keyed.withColumn("_c0", _range_code(F.col("_o0"), moments, ranges))
    return first.withColumn("_c1", F.when(F.col("_c0") % 2 == 0, _range_code(F.col("_o1"), ids, ranges)).otherwise(-1))


def test_ranking_needs_few_exchanges(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 5 as t")
    plan = rank_rows(rows, ["g"], [F.col("t"), id_order("id")], "rn")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 12


def test_plain_fact_joins_are_split_by_adaptive_execution(spark, frame, tmp_path):
    """Joins of facts to plain tables rely on Spark splitting a hot key: see that it can."""
    from lendlane.operators import admission, listings

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    hot = "if(id % 3 = 0, 5, id % 4000)"
    spark.range(300_000).selectExpr(
        "id", f"{hot} as trailer_id", f"cast({hot} + 1 as string) as booking_id", "id as event_id", "cast(null as string) as payment_status"
    ).repartition(8).write.parquet(f"{tmp_path}/facts")
    spark.range(4001).selectExpr(
        "id", "true as busy_display", "false as is_available", "cast(id as decimal(16,5)) as total_price", "'eur' as currency",
        "cast(null as string) as payment_status", "timestamp_ntz'2020-01-01' as starter_expires_at"
    ).write.parquet(f"{tmp_path}/plain")
    facts, plain = spark.read.parquet(f"{tmp_path}/facts"), spark.read.parquet(f"{tmp_path}/plain")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        jobs = {
            "guard_busy": admission.guard_busy(facts, plain),
            "checkout": admission.checkout_audit(facts.select("event_id", "booking_id"), plain),
            "unpaid": admission.unpaid_busy_bookings(facts, plain),
            "unpaid kept": admission.unpaid_busy_bookings(facts, plain, keep=True),
            "expired": listings.expired_profiles(plain, facts, "2021-01-01"),
            "lookup": lookup_join(facts, plain.select(F.col("id").alias("trailer_id"), "currency"), ["trailer_id"], ["id"]),
            "aggregates": attach_aggregates(facts, ["trailer_id"], [F.max("id").alias("top")], ["id"]),
        }
        for name, df in jobs.items():
            df.collect()
            assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString(), name
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
