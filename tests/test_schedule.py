"""Types of episodes: quotas and bounds by counting, impossible ones as errors."""

import random
from collections import Counter

import pytest

from tidemark.operators.schedule import episode_types

EPISODES, QUOTAS = "batch string, episode long, place string", "batch string, type string, quota long, place string"


def test_quotas_are_exact_and_bounds_hold(spark):
    rng = random.Random(5)
    sizes, quotas = {"one": 1, "few": 7, "many": 211}, {}
    for b, n in sizes.items():
        own = [rng.randint(n, 3 * n) for _ in range(6)]
        while not 10 * n <= sum(own) <= 12 * n:
            own = [rng.randint(n, 3 * n) for _ in range(6)]
        quotas[b] = dict(zip("abcdef", own, strict=True))
    rows = [(b, k, "x") for b, n in sizes.items() for k in range(n)]
    episodes = spark.createDataFrame([*rows, rows[0], (None, 1, "x"), ("few", None, "x")], EPISODES)
    wanted = [(b, t, q, "y") for b, own in quotas.items() for t, q in own.items() if t != "a"] + [(b, "a", q, "y") for b, own in quotas.items() for q in (1, own["a"] - 1)]
    wanted = spark.createDataFrame([*wanted, (None, "a", 9, "y"), ("few", None, 9, "y"), ("few", "g", None, "y"), ("absent", "a", 9, "y")], QUOTAS)
    got = episode_types(episodes, wanted, seed=3).collect()
    assert Counter((r.batch, r.type) for r in got) == Counter({(b, t): q for b, own in quotas.items() for t, q in own.items()})
    lengths, each = Counter((r.batch, r.episode) for r in got), Counter((r.batch, r.episode, r.type) for r in got)
    assert set(lengths) == {(b, k) for b, k, _ in rows} and len(each) == 6 * len(lengths) and max(each.values()) <= 3
    for b, n in sizes.items():
        own = [v for (x, _), v in lengths.items() if x == b]
        assert 10 <= min(own) and max(own) <= min(12, min(own) + 1)
        assert all(sorted(r.position for r in got if (r.batch, r.episode) == (b, k)) == list(range(1, lengths[b, k] + 1)) for k in range(min(n, 9)))
    again = episode_types(episodes.repartition(5), wanted, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert sorted(map(tuple, episode_types(episodes, wanted, seed=4).collect())) != sorted(map(tuple, got))


@pytest.mark.parametrize(("quotas", "says"), [
    ({"a": 9, "b": 9}, "batch x: 18 questions for 3 episodes of 2 to 4"), ({"a": 2, "b": 3, "c": 3}, "a type cannot be 1 to 2 times in each of 3"),
    ({"a": 7, "b": 3}, "a type cannot be 1 to 2 times in each of 3"), ({}, "batch x: there are no quotas"),
])
def test_quotas_that_cannot_be_met_are_errors(spark, quotas, says):
    episodes = spark.createDataFrame([("x", k, "") for k in range(3)], EPISODES)
    with pytest.raises(Exception, match=says):
        episode_types(episodes, spark.createDataFrame([("x", t, q, "") for t, q in quotas.items()], QUOTAS), 2, 4, 1, 2).collect()


def test_no_episodes_give_no_rows(spark):
    assert episode_types(spark.createDataFrame([], EPISODES), spark.createDataFrame([("x", "a", 3, "")], QUOTAS)).collect() == []
