import itertools
import pathlib
import random

from pyspark.sql import functions as F

from lendlane.operators.pricing import active_flags, active_state, merge_active_states, one_active_fold
from lendlane.plans.active_state import ActiveProfiles
from tests.conftest import column

KIND = "id bigint, trailer_id bigint, is_active boolean, daily_rate decimal(10,2), updated_at timestamp_ntz"


def profiles(frame, seed, n=80):
    rng = random.Random(seed)
    return frame(KIND, *[
        (i, rng.choice([1, 1, 2, 3, 4, 5, None]), rng.choice([True, False, None]), rng.choice([0, None, None, -1, 9]) if i % 3 else None, None)
        for i in rng.sample(range(1000), n)])


def test_any_batches_give_the_flags_of_the_whole_fold(frame):
    for seed in range(4):
        rows = profiles(frame, seed)
        want = column(one_active_fold(rows), "is_active")
        parts = [active_state(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == p)) for p in range(3)]
        for order in itertools.islice(itertools.permutations(parts), 0, 6, 2):
            state = merge_active_states(order[0], merge_active_states(*order[1:]), order[0])
            assert column(active_flags(rows, state), "is_active") == want
            assert sorted(map(tuple, state.collect())) == sorted(map(tuple, active_state(rows).collect()))


def test_stored_state_takes_a_load_once_and_touches_its_buckets_only(spark, frame, tmp_path):
    kept = ActiveProfiles(str(tmp_path / "active"), 16)
    kept.create(spark)
    first, second = profiles(frame, 7), frame(KIND, (5000, 2, True, 12, None))
    assert kept.add(first, "first") and not kept.add(first, "first")
    files = {p: p.stat().st_mtime_ns for p in pathlib.Path(kept.folder, "rows").glob("bucket=*/*.parquet")}
    assert kept.add(second, "second")
    after = {p: p.stat().st_mtime_ns for p in pathlib.Path(kept.folder, "rows").glob("bucket=*/*.parquet")}
    assert len(files) > 1 and len(set(files.items()) - set(after.items())) == 1
    both = first.unionAll(second)
    assert column(kept.flags(both), "is_active") == column(one_active_fold(both), "is_active")
    assert kept.add(frame(KIND), "nothing")
    assert kept.state(spark).count() == active_state(both).count()
