import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlake.operators.intervals import interval_gaps, merge_intervals

SCHEMA = "who string, a bigint, b bigint, gap_start string, extra int"


def brute(rows, touch=1):
    periods, gaps = [], []
    for who in {r[0] for r in rows}:
        own = sorted((a, b) for w, a, b in rows if w == who and a is not None and b is not None and b >= a)
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1] + touch:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        periods += [(who, a, b) for a, b in merged]
        gaps += [(who, x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])]
    key = lambda t: (t[0] or "", t[1:])
    return sorted(periods, key=key), sorted(gaps, key=key)


def check(spark, rows, width):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    key = lambda t: (t[0] or "", t[1:])
    periods = sorted((tuple(r) for r in merge_intervals(df, ["who"], "a", "b", bin_width=width).collect()), key=key)
    gaps = sorted((tuple(r) for r in interval_gaps(df, ["who"], "a", "b", bin_width=width).collect()), key=key)
    assert (periods, gaps) == brute(rows)


def test_random(spark):
    r = random.Random(4)
    for width in (1, 7, 50, 10_000):
        rows = []
        for _ in range(250):
            a = r.randint(-50, 600)
            rows.append((r.choice(["x", "x", "x", "y", None]), r.choice([a] * 20 + [None]), r.choice([a + r.randint(-1, 12)] * 20 + [None, a + 300])))
        check(spark, rows + rows[:30], width)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q"]), st.integers(-20, 60), st.integers(-20, 80)), max_size=25))
def test_any(spark, rows):
    check(spark, rows, 8)


def test_empty_and_times(spark):
    assert interval_gaps(spark.createDataFrame([], SCHEMA), ["who"], "a", "b").count() == 0
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([("x", t(0), t(2)), ("x", t(1), t(3)), ("x", t(30), t(31)), ("x", t(90), t(91))], "who string, a timestamp, b timestamp")
    assert sorted((r["period_start"], r["period_end"]) for r in merge_intervals(df, ["who"], "a", "b", touch=0).collect()) == [(t(0), t(3)), (t(30), t(31)), (t(90), t(91))]
    assert sorted((r["gap_start"], r["gap_end"]) for r in interval_gaps(df, ["who"], "a", "b", touch=0).collect()) == [(t(3), t(30)), (t(31), t(90))]
