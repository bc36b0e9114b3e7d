"""Folds along tracks, spectra and nearest points against numpy and plain Python."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import nearest, scenes, temporal, tracks
from tidemark.streaming import streams


def walk(seed, n):
    rng = random.Random(seed)
    out, at = [], 0.0
    for _ in range(n):
        at += rng.gauss(0.5, 2)
        out.append(at)
    return out


def test_kalman_and_smoother_equal_matrices(spark):
    values = {k: walk(k, 5 + 40 * k) for k in range(4)} | {9: [3.0]}
    rows = [(k, t, v, "x") for k, own in values.items() for t, v in enumerate(own)] + [(None, 1, 1.0, "x"), (5, None, 1.0, "x"), (5, 1, None, "x")]
    random.Random(1).shuffle(rows)
    data = spark.createDataFrame(rows, "k long, t long, v double, place_name string")
    found = tracks.smoothed(tracks.kalman(data, "k", "t", "v", 0.5, 9.0, 4.0, 7.0), "k", "t", 0.5, 9.0).collect()
    dt = 0.5
    f, h, q = np.array([[1, dt], [0, 1]]), np.array([[1.0, 0]]), 9.0 * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
    for k, own in values.items():
        x, p, held = np.array([own[0], 0.0]), 7.0 * np.eye(2), []
        for z in own:
            xe, pe = f @ x, f @ p @ f.T + q
            gain = pe @ h.T / (pe[0, 0] + 4.0)
            x, p = xe + (gain * (z - xe[0])).ravel(), (np.eye(2) - gain @ h) @ pe
            held.append((xe, pe, x, p))
        smooth = [held[-1][2]]
        for (_, _, x, p), (xe, pe, _, _) in zip(held[-2::-1], held[:0:-1], strict=True):
            smooth.append(x + p @ f.T @ np.linalg.inv(pe) @ (smooth[-1] - xe))
        rows = sorted((r for r in found if r.k == k), key=lambda r: r.t)
        assert np.allclose([(r.place, r.speed) for r in rows], [x for _, _, x, _ in held]) and np.allclose([(r.smooth_place, r.smooth_speed) for r in rows], smooth[::-1])
    assert [r.place for r in found if r.k == 5] == [None]


def test_angles_take_the_nearest_turn(spark):
    data = spark.createDataFrame([(1, t, (350 + 5 * t) % 360.0) for t in range(30)], "k long, t long, v double")
    found = [r.place for r in sorted(tracks.kalman(data, "k", "t", "v", angle=True).collect(), key=lambda r: r.t)]
    assert all(b > a for a, b in zip(found, found[1:], strict=False)) and found[-1] == pytest.approx(495, abs=1)


def test_capped_steps(spark):
    values = walk(7, 200)
    data = spark.createDataFrame([(k, t, v * (k + 1)) for k in range(3) for t, v in enumerate(values)], "k long, t long, v double")
    for k in range(3):
        want = [values[0] * (k + 1)]
        for v in values[1:]:
            want.append(want[-1] + max(-1.5, min(1.5, v * (k + 1) - want[-1])))
        got = [r.capped for r in sorted((r for r in tracks.capped(data, "k", "t", "v", 1.5).collect() if r.k == k), key=lambda r: r.t)]
        assert got == pytest.approx(want)


def test_spectrum_of_known_turns(spark):
    """A track that swings at one and at four hertz, ten frames a second: the share of power above three is that of the faster swing."""
    t = np.arange(200) / 10
    yaw = 20 * np.sin(2 * np.pi * t) + 5 * np.sin(2 * np.pi * 4 * t)
    rows = [(1, k, float(v)) for k, v in enumerate(yaw % 360)] + [(2, 0, 1.0), (2, 1, 2.0)] + [(3, k, 90.0) for k in range(5)]
    got = {r.k: r for r in tracks.spectra(spark.createDataFrame(rows, "k long, t long, v double"), "k", "t", "v", 10.0).collect()}
    power = {f: (a * 2 * np.sin(np.pi * f / 10)) ** 2 for f, a in ((1, 20), (4, 5))}
    assert got[1].high_ratio == pytest.approx(power[4] / sum(power.values()), abs=1e-6) and got[1].sign_flips > 30
    assert got[2].high_ratio is None and (got[3].high_ratio, got[3].yaw_rate_max) == (0.0, 0.0)


@pytest.mark.parametrize("same", [False, True])
def test_nearest_equals_all_pairs(spark, same):
    rng = random.Random(3)
    points = [(s, 100 * s + k, rng.gauss(0, 1), rng.gauss(0, 1)) for s in range(3) for k in range(60)] + [(0, 900, 500.0, -800.0), (3, 950, 1.0, 1.0)]
    points += [(4, 960 + k, 2.0, 2.0) for k in range(3)]
    asking = points if same else [(s, k, rng.gauss(0, 3), rng.gauss(0, 3)) for s in range(5) for k in range(20)] + [(1, 77, 9000.0, 0.0), (8, 1, 0.0, 0.0)]
    frame = lambda rows: spark.createDataFrame([*rows, (None, 1, 1.0, 1.0), (0, 5000, None, 1.0), (0, 5001, float("nan"), 1.0)], "scene long, id long, x double, y double")
    got = {(r.scene, r.id): (r.nearest, round(r.distance, 9)) for r in nearest.nearest(frame(asking), frame(points), 0.2, same).collect()}
    want = {}
    for s, i, x, y in asking:
        near = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for z, j, a, b in points if z == s and (not same or j != i)]
        if near:
            want[s, i] = (min(near)[1], round(min(near)[0], 9))
    assert got == want


def test_time_joins_equal_all_pairs(spark):
    """Events among frames, segments in gaps, visits in segments and frames before questions: windows and buckets against loops, with ties."""
    rng = random.Random(5)
    keys = range(4)
    frames = sorted({(k, rng.randrange(60)) for k in keys for _ in range(25)})
    spans = [(i, rng.choice(keys), rng.randrange(60), rng.randrange(0, 9)) for i in range(80)]
    events = spark.createDataFrame([(i, k, a, a + n) for i, k, a, n in spans], "seq long, k long, start long, end long")
    f = spark.createDataFrame(frames, "k long, t long")
    got = {r.seq: (r.before, r.after) for r in temporal.retimed(events, f, "k").collect()}
    assert got == {i: (max((t for x, t in frames if x == k and t < a), default=None), min((t for x, t in frames if x == k and t > a + n), default=None)) for i, k, a, n in spans}
    visits = sorted({(k, 7 * j, 7 * j + rng.randrange(0, 7)) for k in keys for j in range(9) if rng.random() < 0.7})
    gaps = [(k, b, c) for (k, _, b), (z, c, _) in zip(visits, visits[1:], strict=False) if k == z]
    got = sorted((r.seq, r.since, r.until) for r in temporal.inside_gaps(events.where("end > start"), spark.createDataFrame(visits, "k long, start long, end long"), "k").collect())
    assert got == sorted((i, b, c) for i, k, a, n in spans if n for z, b, c in gaps if z == k and a >= b and a + n <= c)
    segments = [(i, rng.choice(keys), rng.randrange(60), rng.randrange(0, 40)) for i in range(40)]
    s = spark.createDataFrame([(i, k, a, a + n) for i, k, a, n in segments], "seq long, k long, start long, end long")
    got = {r.seq: r.segment for r in scenes.contained(events, s, "k", 10).collect()}
    held = {i: min((j for j, z, b, m in segments if z == k and b <= a and a + n <= b + m), default=None) for i, k, a, n in spans}
    assert got == {i: j for i, j in held.items() if j is not None}
    asks = [(k, i, float(rng.randrange(60))) for i, k in enumerate([0, 0, 0, 1, 1, 2])] + [(0, 9, 30.0), (0, 10, 30.0)]
    got = sorted((r.k, r.id, r.t) for r in streams.prefix_frames(f, spark.createDataFrame(asks, "k long, id long, query_time double"), "k").collect())
    first = lambda k, t: min(((q, i) for z, i, q in asks if z == k and t <= q + 1e-6), default=None)
    assert got == sorted((k, first(k, t)[1], t) for k, t in frames if first(k, t))
