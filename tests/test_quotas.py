"""Quota selections against all possible ones, and positions by counting."""

import itertools
import random
from collections import Counter

import pytest

from tidemark.operators import quotas


def pool(seed, n=14):
    rng = random.Random(seed)
    return [{"episode": f"e{k % 2}", "type": rng.choice("ab"), "status": rng.choice(["known", "known", "uncertain"]), "fact": f"f{rng.randrange(5)}", "marks": [f"time {rng.randrange(3)}", f"level {rng.randrange(2)}"], "cost": rng.random() / 100} for k in range(n)]


RANGES = {"known": (1, 3), "uncertain": (0, 2)}


def fits(own, want, each, most):
    return (
        Counter((c["type"], c["status"]) for c in own) == Counter(want) and set(Counter(c["episode"] for c in own).values()) == {each} and max(Counter((c["episode"], c["status"], c["fact"]) for c in own).values()) == 1
        and max(Counter((c["episode"], c["type"]) for c in own).values()) <= most and all(low <= sum(c["episode"] == e and c["status"] == s for c in own) <= high for e in ("e0", "e1") for s, (low, high) in RANGES.items())
    )


def off(own, targets):
    counts = Counter(m for c in own for m in c["marks"])
    return sum(abs(counts[m] - t) for m, t in targets.items())


def test_no_selection_is_nearer_to_the_marginals():
    targets = {"time 0": 2.0, "time 1": 2.5, "time 2": 1.5, "level 0": 2.0, "level 1": 4.0}
    tried = 0
    for seed in range(60):
        cells = pool(seed)
        want = {("a", "known"): 2, ("b", "known"): 2, ("a", "uncertain"): 1, ("b", "uncertain"): 1}
        every = [own for own in itertools.combinations(cells, 6) if fits(own, want, 3, 2)]
        try:
            got = [cells[k] for k in quotas.quota_cells(cells, want, targets, dict.fromkeys(targets, 1.0), 3, RANGES, 2)]
        except ValueError:
            assert not every
            continue
        assert fits(got, want, 3, 2) and off(got, targets) == pytest.approx(min(off(own, targets) for own in every)), seed
        tried += 1
    assert tried > 10


def test_batches(spark):
    rows = [(b, 100 * b + k, *(c[f] for f in ("episode", "type", "status", "fact", "marks", "cost")), "x") for b in range(3) for k, c in enumerate(pool(30 + b, 60))]
    data = spark.createDataFrame([*rows, rows[0], (None, 1, "e0", "a", "known", "f", [], 0.0, "x"), (1, None, "e0", "a", "known", "f", [], 0.0, "x")], "batch long, id long, episode string, type string, status string, fact string, marks array<string>, cost double, place string")
    want, targets = {("a", "known"): 3, ("b", "known"): 3, ("a", "uncertain"): 1, ("b", "uncertain"): 1}, {"time 0": 3.0, "level 1": 4.0}
    chosen, marginals = quotas.quota_selection(data, want, targets, dict.fromkeys(targets, 1.0), 4, {"known": (2, 4), "uncertain": (0, 2)}, 3)
    by_id = {r[1]: r for r in rows}
    taken = {b: [by_id[r.id] for r in chosen.collect() if r.batch == b] for b in range(3)}
    for own in taken.values():
        assert Counter((r[3], r[4]) for r in own) == Counter(want) and set(Counter(r[2] for r in own).values()) == {4} and max(Counter((r[2], r[4], r[5]) for r in own).values()) == 1
    for r in marginals.collect():
        assert r.actual == sum(r.mark in x[6] for x in taken[r.batch]) and r.target == targets[r.mark]
    with pytest.raises(Exception, match="batch .: the quotas"):
        quotas.quota_selection(data.where("type = 'a' or batch <> 1"), want, targets, dict.fromkeys(targets, 1.0), 4, {"known": (2, 4), "uncertain": (0, 2)})[0].count()
    with pytest.raises(Exception, match="quotas of 8 for 2 episodes of 5"):
        quotas.quota_selection(data, want, targets, dict.fromkeys(targets, 1.0), 5, {"known": (2, 4)})[0].count()


def test_flow_prefers_bounds_to_costs():
    net = quotas.Flow()
    dear, cheap = net.add("s", "a", 2, 3, 5.0), net.add("s", "b", 0, 9, 1.0)
    net.add("a", "t", 0, 9)
    net.add("b", "t", 0, 9)
    assert net.send("s", "t", 5) == 5 and (net.flow(dear), net.flow(cheap)) == (2, 3) and net.send("s", "t", 99) == 7


def test_positions_are_balanced_in_every_group(spark):
    rng = random.Random(2)
    rows = [(b, f"q{b}-{k}", rng.choice("abc"), rng.choice(["known", "uncertain"]), f"e{rng.randrange(9)}") for b in range(3) for k in range((90, 31, 3)[b])]
    data = spark.createDataFrame([*rows, rows[0], (None, "x", "a", "known", "e")], "batch long, id string, type string, status string, episode string")
    got = quotas.balanced_positions(data, ["type", "status"], ["episode"], 4, 7).collect()
    assert Counter((r.batch, r.id) for r in got) == Counter((b, i) for b, i, *_ in rows)
    groups = {}
    for r in got:
        for g in ((r.batch,), (r.batch, "type", r.type), (r.batch, "both", r.type, r.status), (r.batch, "episode", r.episode)):
            groups.setdefault(g, []).append(r.position)
    for g, own in groups.items():
        counts = [own.count(p) for p in range(4)]
        assert max(counts) - min(counts) <= 1, g
    assert [sum(r.position == p for r in got if r.batch == 1) for p in range(4)] == [8, 8, 8, 7]
    again = {(r.batch, r.id): r.position for r in quotas.balanced_positions(data.repartition(5), ["type", "status"], ["episode"], 4, 7).collect()}
    assert again == {(r.batch, r.id): r.position for r in got}
