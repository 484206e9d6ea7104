import numpy as np
import pytest

from lendlane.llm import negatives
from tests.conftest import as_dicts


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (17, 33, 40), (64, 64, 64), (100, 7, 90), (50, 70, 0), (4, 0, 4)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2**20, 2**20, shape[:2]), rng.integers(-2**20, 2**20, shape[1:])
    assert (negatives.strassen(a, b, 4) == a @ b).all()


def plain(rows):
    """The contract, row by row."""
    good = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    out = []
    for i, label, v in good:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in good if j != i)
        for p, j, m in [s for s in scored if s[2] == label][:5]:
            fits = [(q, k) for q, k, m in scored if m != label and 80 * -p <= 100 * -q <= 100 * -p][:5]
            out += [(i, j, rank, k, -p, -q) for rank, (q, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, settings=negatives.Settings()):
    got = negatives.hard_negatives(df, negatives.ANCHORS, negatives.SHIFTED, settings)
    assert tuple(got.columns) == negatives.COLUMNS
    return sorted(tuple(r.values()) for r in as_dicts(got))


def test_against_a_plain_version(frame):
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice([-0.5, -0.1, 0.1, 0.3, 0.5], 12).tolist(), int(rng.integers(0, 4))) for i in range(0, 900)]
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(90)]  # ties
    rows += [(100, rows[100][1], rows[100][2]), (3, rows[3][1], 2)]  # repeated rows, one of them an anchor
    rows += [(2000, None, 1), (2100, [0.1] * 12, None), (None, [0.1] * 12, 1), (2200, [None] + [0.1] * 11, 1),
             (2300, [float("nan")] * 12, 1), (2400, [float("inf")] * 12, 1), (2500, [], 1), (2600, [0.25], 1), (2700, [0.1] * 40, 2)]
    df = frame("vec_id long, embedding array<float>, label int, rank string, anchor string", *[(*r, "x", "y") for r in rows])
    expected = plain(rows)
    assert len(expected) > 100 and mined(df) == expected
    # many small blocks and tiles give the same
    assert mined(df.repartition(5), negatives.Settings(tile=7, leaf=2, block_rows=3)) == expected


def test_without_rows_positives_or_negatives(frame):
    kind = "vec_id long, embedding array<double>, label int"
    assert mined(frame(kind)) == []
    assert mined(frame(kind, (100, [1.0], 1))) == []
    assert mined(frame(kind, (100, [1.0], 1), (101, [1.0], 1))) == []
    assert mined(frame(kind, (100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2))) == [(100, 101, 1, 102, 65536, 58880)]
    # a negative score leaves no window
    assert mined(frame(kind, (100, [1.0], 1), (101, [-1.0], 1), (102, [-0.9], 2))) == []
    assert mined(frame(kind, (100, [1.0], 1), (101, [1e300], 1), (102, [0.9], 2))) == mined(frame(kind, (100, [1.0], 1), (101, [1e308], 1), (102, [0.9], 2)))
