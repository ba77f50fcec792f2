import random
from bisect import bisect_right

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shorespark.llm.nearest_time import DAY, ERROR, nearest_in_time, piecewise_linear, steps


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12), st.sampled_from("abcdef")), min_size=1, max_size=9))
def test_steps_equal_brute_force(rows):
    start = np.array([s for s, _, _ in rows])
    end = start + np.array([n for _, n, _ in rows])
    name = np.array([c for _, _, c in rows])
    keys, who = steps(start, end, name)
    assert all(a < b for a, b in zip(keys, keys[1:]))
    rank = lambda t, j: (max(0, start[j] - t, t - end[j]), -start[j], name[j])
    for t in range(-10, 65):
        assert rank(t, who[bisect_right(keys, t) - 1]) == min(rank(t, j) for j in range(len(rows)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=400, unique=True))
def test_prediction_error_is_bounded(values):
    keys = np.array(sorted(values), dtype=np.int64)
    first, slope, place = piecewise_linear(keys)
    for i, k in enumerate(keys):
        s = bisect_right(first, int(k)) - 1
        assert abs(place[s] + slope[s] * (int(k) - first[s]) - i) <= ERROR


def pairs(spark, left, right, **kw):
    L = spark.createDataFrame(left, "k long, e string, t long, w int, name string")
    R = spark.createDataFrame(right, "e string, id string, s long, f long, keys string")
    got = nearest_in_time(L, "k", "e", "t", "w", R, "e", "id", "s", "f", **kw).collect()
    return sorted((r.k, r.id, r.distance_us) for r in got)


def brute(left, right):
    out = []
    for k, e, t, w, _ in left:
        own = [(max(0, s - t, t - f), -s, i) for g, i, s, f, _ in right if t is not None and e is not None and g == e and s is not None and f is not None and s <= f and i is not None]
        if own and w is not None and w >= 0 and (best := min(own))[0] <= w * DAY:
            out.append((k, best[2], best[0]))
    return sorted(out)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    right = [(rnd.choice(["a", "a", "b", None]), f"n{rnd.randint(0, 150)}", (s := rnd.randint(0, 3000)) * DAY, (s + rnd.choice([-1, 0, 0, 1, 3, 200])) * DAY, "x") for _ in range(300)]
    right += right[:20] + [("a", None, 0, DAY, "x"), ("a", "z", None, DAY, "x")]
    left = [(i, rnd.choice(["a", "a", "b", "c", None]), rnd.randint(-100, 3300) * DAY // 2 + rnd.choice([0, 1, 12345]), rnd.choice([0, 1, 3, 7, 400, None, -1]), "x") for i in range(1500)]
    left += [(5000, "a", None, 3, "x"), (5001, "a", 0, 3, "x"), (5001, "a", 0, 3, "x")]
    want = brute(left, right)
    assert pairs(spark, left, right) == want
    assert pairs(spark, left, right, shard_days=4) == want


def test_nothing(spark):
    row = [(1, "a", 0, 3, "x")]
    assert pairs(spark, row, []) == [] and pairs(spark, [], [("a", "n", 0, DAY, "x")]) == []
