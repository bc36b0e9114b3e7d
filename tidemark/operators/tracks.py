"""Folds along tracks (Kalman filter and smoother, capped steps) and their spectra.

A fold takes rows in the order of (key, time) and holds one track's state at a time: rows are dealt by key, sorted in each partition, and read in Arrow batches, so a
track of any length needs the memory of its state alone.

Defined results: rows without a key or time are ignored; a row without a value leaves the state as it is and has no result; rows of one time are taken in the order of the
value; a track of one row is its own result; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_sorted(rows: DataFrame, key: str, order: str, inputs: list[str], names: list[str], step: Callable, backwards: bool = False) -> DataFrame:
    """rows with more columns (doubles): step(state, values) gives the next state and the values of `names`; a key's first state is None."""
    fields = [*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]
    direction = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    placed = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).repartition(key).sortWithinPartitions(key, direction(order), *[direction(c) for c in inputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, None
        for b in batches:
            out = []
            for k, *values in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in inputs), strict=True):
                if k != before:
                    before, state = k, None
                if any(v is None for v in values):
                    out.append((None,) * len(names))
                    continue
                state, own = step(state, values)
                out.append(own)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.float64()) for c in cols)], names=[f.name for f in fields])

    return placed.mapInArrow(run, T.StructType(fields))


def kalman(rows: DataFrame, key: str, order: str, value: str, dt: float = 1.0, process: float = 900.0, noise: float = 64.0, first: float = 100.0, angle: bool = False) -> DataFrame:
    """Adds place, speed and the variances (p00, p01, p11) of a constant-velocity filter; of angles, in degrees, the nearest turn of each is measured.

    The first measurement is the first state, with variances `first`; noise is the measurements' variance, process that of the acceleration.
    """
    q = (process * dt**4 / 4, process * dt**3 / 2, process * dt**2)

    def step(state, values):
        z = values[0]
        x, v, p00, p01, p11, last = (z, 0.0, first, 0.0, first, z) if state is None else state
        if angle:
            z = last + (z - last + 180.0) % 360.0 - 180.0
        x, p00, p01, p11 = x + dt * v, p00 + 2 * dt * p01 + dt * dt * p11 + q[0], p01 + dt * p11 + q[1], p11 + q[2]
        k0, k1 = p00 / (p00 + noise), p01 / (p00 + noise)
        x, v, p11 = x + k0 * (z - x), v + k1 * (z - x), p11 - k1 * p01
        p00, p01 = (1 - k0) * p00, (1 - k0) * p01
        return (x, v, p00, p01, p11, z), (x, v, p00, p01, p11)

    return fold_sorted(rows, key, order, [value], ["place", "speed", "p00", "p01", "p11"], step)


def smoothed(filtered: DataFrame, key: str, order: str, dt: float = 1.0, process: float = 900.0) -> DataFrame:
    """Adds smooth_place and smooth_speed to kalman()'s rows: the same recursion backwards (Rauch, Tung and Striebel), from each track's end."""
    q = (process * dt**4 / 4, process * dt**3 / 2, process * dt**2)

    def step(state, values):
        x, v, p00, p01, p11 = values
        if state is None:
            return (x, v), (x, v)
        # what the filter expected next, and the gain p f' / expected p
        e00, e01, e11 = p00 + 2 * dt * p01 + dt * dt * p11 + q[0], p01 + dt * p11 + q[1], p11 + q[2]
        size = e00 * e11 - e01 * e01
        a0, a1, b0, b1 = p00 + dt * p01, p01, p01 + dt * p11, p11
        g00, g01, g10, g11 = (a0 * e11 - a1 * e01) / size, (a1 * e00 - a0 * e01) / size, (b0 * e11 - b1 * e01) / size, (b1 * e00 - b0 * e01) / size
        dx, dv = state[0] - (x + dt * v), state[1] - v
        own = x + g00 * dx + g01 * dv, v + g10 * dx + g11 * dv
        return own, own

    return fold_sorted(filtered, key, order, ["place", "speed", "p00", "p01", "p11"], ["smooth_place", "smooth_speed"], step, True)


def capped(rows: DataFrame, key: str, order: str, value: str, most: float) -> DataFrame:
    """Adds `capped`: each value no further than `most` from the one before it as capped."""

    def step(state, values):
        own = values[0] if state is None else state + max(-most, min(most, values[0] - state))
        return own, (own,)

    return fold_sorted(rows, key, order, [value], ["capped"], step)


def yaw_quality(yaws: list[float], fps: float, high: float = 3.0) -> tuple | None:
    """Of a closed track of headings in degrees: rate (95th percentile, most), acceleration (most), changes of the turn's sign, share of the turn's power at `high` hertz or more."""
    if len(yaws) < 3:
        return None
    own = np.array(yaws, np.float64)
    rate = ((np.roll(own, -1) - own + 180.0) % 360.0 - 180.0) * fps
    faster = (np.roll(rate, -1) - rate) * fps
    turning = np.sign(rate[np.abs(rate) >= 1.0])
    power = np.abs(np.fft.rfft(rate - rate.mean())) ** 2
    total = float(power[1:].sum())
    share = float(power[np.fft.rfftfreq(len(rate), 1 / fps) >= high].sum()) / total if total > 1e-9 else 0.0
    return float(np.percentile(np.abs(rate), 95)), float(np.abs(rate).max()), float(np.abs(faster).max()), int((turning[1:] * turning[:-1] < 0).sum()), share


def spectra(rows: DataFrame, key: str, order: str, yaw: str, fps: float = 1.0, high: float = 3.0) -> DataFrame:
    """Per track: n, yaw_rate_p95, yaw_rate_max, yaw_acceleration_max, sign_flips, high_ratio; nulls for tracks of under three headings.

    A transform needs its whole track: a track is one list, tracks go by Arrow batches.
    """
    lists = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(yaw).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(yaw).cast("double").alias("y")))), lambda x: x["y"]).alias("yaws"))
    names = ["yaw_rate_p95", "yaw_rate_max", "yaw_acceleration_max", "sign_flips", "high_ratio"]
    schema = T.StructType([rows.schema[key], T.StructField("n", T.LongType()), *[T.StructField(n, T.LongType() if n == "sign_flips" else T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("yaws").to_pylist()
            found = [yaw_quality(y, fps, high) or (None,) * 5 for y in own]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.int64() if n == "sign_flips" else pa.float64() for n in names]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([len(y) for y in own], pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    return lists.mapInArrow(run, schema)
