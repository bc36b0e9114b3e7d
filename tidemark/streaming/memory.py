"""Stateful episodes: frames are observed in order, questions are answered from a memory of bounded size, in a stream or in one batch.

The memory of an episode has a short part, of the last frames that do not yet fill a fragment, and a long part of clips (a mean vector and the frames it stands
for). A full fragment is reduced by merging the two most similar neighbours, again and again, until `keep` clips are left, and these are added to the long part; if that passes its
capacity, its most similar neighbours are merged likewise. An answer sees both parts and how large they are, never a frame after its own time.

Defined results: of rows of one time frames come before questions; a frame before the last one observed is late: it is counted and not observed; frames without a vector, or
of another length than those before, are late too; a question that is marked done is not answered again, but its episode is replayed for those that
are not; questions before any frame see an empty memory; rows without an episode or time are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWERS = "episode long, id long, t double, frames_seen long, late long, clips long, clip_frames long, state_bytes long, similarity double"


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a @ b) / size if size > 0 else 0.0


def merged(clips: list[tuple[np.ndarray, int]], most: int) -> list[tuple[np.ndarray, int]]:
    """Merges the most similar neighbours, the first of equal ones, until `most` clips are left."""
    clips = list(clips)
    near = [cosine(a, b) for (a, _), (b, _) in zip(clips, clips[1:], strict=False)]
    while len(clips) > max(most, 1):
        k = int(np.argmax(near))
        (a, n), (b, m) = clips[k], clips[k + 1]
        clips[k : k + 2] = [((a * n + b * m) / (n + m), n + m)]
        near[k : k + 1] = []
        for j in (k - 1, k):
            if 0 <= j < len(near):
                near[j] = cosine(clips[j][0], clips[j + 1][0])
    return clips


@dataclass
class Memory:
    fragment: int = 8
    keep: int = 2
    capacity: int = 16
    short: list[np.ndarray] = field(default_factory=list)
    long: list[tuple[np.ndarray, int]] = field(default_factory=list)
    seen: int = 0
    late: int = 0
    last: float = float("-inf")

    def observe(self, t: float, vector) -> None:
        size = len(self.short[0]) if self.short else len(self.long[0][0]) if self.long else None
        if vector is None or t < self.last or size not in (None, len(vector)):
            self.late += 1
            return
        self.seen, self.last = self.seen + 1, t
        self.short.append(np.array(vector, np.float64))
        if len(self.short) == self.fragment:
            self.long = merged(self.long + merged([(v, 1) for v in self.short], self.keep), self.capacity)
            self.short = []

    def answer(self, episode: int, own: int, t: float) -> tuple:
        """What a question finds: sizes, and the largest similarity of the latest frame with a clip."""
        clips = self.long + [(v, 1) for v in self.short]
        latest = self.short[-1] if self.short else self.long[-1][0] if self.long else None
        best = max((cosine(latest, v) for v, _ in clips), default=None) if latest is not None and len(clips) > 1 else None
        if self.short and len(clips) > 1:
            best = max(cosine(latest, v) for v, _ in clips[:-1])
        return episode, own, t, self.seen, self.late, len(clips), sum(n for _, n in clips), sum(8 * len(v) + 8 for v, _ in clips), None if best is None else round(best, 6)

    def taken(self, episode: int, rows: pd.DataFrame) -> list[tuple]:
        """Observes and answers some rows (t, ask, id, vector, done) in order; gives the answers."""
        out = []
        for r in rows.sort_values(["t", "ask", "id"], kind="stable").itertuples():
            if not r.ask:
                self.observe(r.t, r.vector)
            elif not r.done:
                out.append(self.answer(episode, r.id, r.t))
        return out


def timeline(frames: DataFrame, asks: DataFrame) -> DataFrame:
    """frames (episode, id, t, vector) and asks (episode, id, t, done) as one table of rows, batch or stream."""
    none = F.lit(None).cast(frames.schema["vector"].dataType)
    a = frames.select("episode", "id", F.col("t").cast("double").alias("t"), F.lit(False).alias("ask"), "vector", F.lit(False).alias("done"))
    b = asks.select("episode", "id", F.col("t").cast("double").alias("t"), F.lit(True).alias("ask"), none.alias("vector"), F.coalesce("done", F.lit(False)).alias("done"))
    return a.unionByName(b).where("episode is not null and t is not null")


def framed(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])


def answers(rows: DataFrame, fragment: int = 8, keep: int = 2, capacity: int = 16) -> DataFrame:
    """The batch form: all of an episode in the order of time. An episode is a recording, so a task holds one at a time."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return framed(Memory(fragment, keep, capacity).taken(key[0], own))

    return rows.groupBy("episode").applyInPandas(run, ANSWERS)


class Episodes(StatefulProcessor):
    """The stream form: the memory between micro-batches is list and value state, of a size that the capacities bound."""

    def __init__(self, fragment: int, keep: int, capacity: int):
        self.sizes = fragment, keep, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.short = handle.getListState("short", "v array<double>")
        self.long = handle.getListState("long", "v array<double>, n long")
        self.counts = handle.getValueState("counts", "seen long, late long, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory = Memory(*self.sizes)
        if self.counts.exists():
            memory.seen, memory.late, memory.last = self.counts.get()
            memory.short = [np.array(v, np.float64) for (v,) in self.short.get()] if self.short.exists() else []
            memory.long = [(np.array(v, np.float64), n) for v, n in self.long.get()] if self.long.exists() else []
        out = memory.taken(key[0], pd.concat(list(rows)))
        self.counts.update((memory.seen, memory.late, memory.last))
        for state, held in ((self.short, [(v.tolist(),) for v in memory.short]), (self.long, [(v.tolist(), n) for v, n in memory.long])):
            if held:
                state.put(held)
            elif state.exists():
                state.clear()
        yield framed(out)

    def close(self) -> None:
        pass


def streamed_answers(rows: DataFrame, fragment: int = 8, keep: int = 2, capacity: int = 16) -> DataFrame:
    """The same over a stream of rows (needs the RocksDB state store): rows of an episode must arrive in the order of time from one micro-batch to the next."""
    return rows.groupBy("episode").transformWithStateInPandas(Episodes(fragment, keep, capacity), ANSWERS, "Append", "None")
