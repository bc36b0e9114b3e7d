"""Memories of episodes in batch and stream, and results that are appended once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ledger, memory

ROWS = "episode long, id long, t double, ask boolean, vector array<double>, done boolean"


def episodes(seed, n=3, frames=90):
    rng = random.Random(seed)
    rows = []
    for e in range(n):
        for k in range(frames + 20 * e):
            rows.append((e, 1000 * e + k, float(k), False, [rng.gauss(k // 20, 1) for _ in range(4)], False))
            if k % 13 == 5:
                rows.append((e, 1000 * e + k, float(k), True, None, k % 2 == 0))
    rows += [(0, 7000, 1.5, True, None, False), (1, 7001, -3.0, True, None, False), (2, 7002, 3.0, False, None, False), (2, 7003, 4.0, False, [1.0], False), (None, 1, 1.0, False, [1.0], False)]
    return rows


def plain(rows, fragment, keep, capacity):
    """The memory written out, with all similarities computed anew at each merge."""
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    def shrink(clips, most):
        while len(clips) > most:
            k = max(range(len(clips) - 1), key=lambda k: (cos(clips[k][0], clips[k + 1][0]), -k))
            (a, n), (b, m) = clips[k], clips[k + 1]
            clips = clips[:k] + [((np.array(a) * n + np.array(b) * m) / (n + m), n + m)] + clips[k + 2 :]
        return clips

    out = set()
    for e in {r[0] for r in rows} - {None}:
        short, long, seen, late = [], [], 0, 0
        for _, i, t, ask, v, done in sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[3], r[1])):
            if ask:
                if not done:
                    out.add((e, i, t, seen, late, len(short) + len(long), len(short) + sum(n for _, n in long)))
            elif v is None or len(v) != 4:
                late += 1
            else:
                seen += 1
                short.append(v)
                if len(short) == fragment:
                    long, short = shrink(long + shrink([(x, 1) for x in short], keep), capacity), []
        assert len(long) <= capacity
    return out


@pytest.mark.parametrize("sizes", [(8, 2, 6), (4, 4, 3), (1, 1, 5)])
def test_batch_form_equals_plain_python(spark, sizes):
    rows = episodes(1)
    got = memory.answers(spark.createDataFrame(rows, ROWS).where("episode is not null"), *sizes).collect()
    assert {tuple(r)[:7] for r in got} == plain(rows, *sizes) and all(r.clips <= sizes[2] + sizes[0] - 1 and r.state_bytes <= 40 * (sizes[2] + sizes[0] - 1) for r in got)
    assert memory.answers(spark.createDataFrame([], ROWS), *sizes).count() == 0


def test_stream_form_equals_batch_form(spark, tmp_path):
    """Frames in order over six micro-batches; a question is answered in the batch it comes in."""
    rows = [r for r in episodes(2) if r[0] is not None and r[1] < 7000]
    data = spark.createDataFrame(rows, ROWS)
    for k in range(6):
        data.where((F.col("t") >= 25 * k) & (F.col("t") < 25 * k + 25)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}.parquet"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    snapshots = ledger.Snapshots()
    spark.streams.addListener(snapshots)
    try:
        got = []
        for k in range(6):  # the stream is stopped and taken up again after each batch
            stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/[0-{k}].parquet")
            query = memory.streamed_answers(stream, 8, 2, 6).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.streams.removeListener(snapshots)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = memory.answers(data, 8, 2, 6).collect()
    assert len(want) > 10 and sorted(map(tuple, got)) == sorted(map(tuple, want))


SIGN = "model-1"


def written(spark, folder):
    own = ledger.results(spark, folder)
    return [] if own is None else sorted((r.id, r.pred) for r in own.collect())


def test_a_batch_run_twice_counts_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "id long, pred string")
    assert written(spark, folder) == [] and ledger.append_once(rows(1, 2, 2), 0, folder, SIGN, "a") == 2
    assert ledger.append_once(rows(1, 2), 0, folder, SIGN, "a") == 0
    assert ledger.append_once(rows(2, 3), 1, folder, SIGN, "a") == 1 and ledger.append_once(rows(3, 4), 0, folder, SIGN, "b") == 1
    assert written(spark, folder) == [(i, f"p{i}") for i in (1, 2, 3, 4)]
    with pytest.raises(ValueError, match="another configuration"):
        ledger.append_once(rows(9), 2, folder, "model-2", "a")
    with pytest.raises(Exception, match="no id"):
        ledger.append_once(rows(None), 2, folder, SIGN, "a")
    items = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(1, 7)], "id long, episode string")
    assert sorted(r.id for r in ledger.pending(items, folder).collect()) == [5, 6]
    assert sorted((r.episode, r.items, r.done, r.complete) for r in ledger.progress(items, folder, "episode").collect()) == [("x", 3, 2, False), ("y", 3, 2, False)]


def test_a_run_stopped_between_part_and_ledger(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "p1"), (2, "p2")], "id long, pred string")
    rows.write.parquet(f"{folder}/rows/run=a/batch=0")  # the part is there, its entry is not
    assert written(spark, folder) == [] and ledger.append_once(rows, 0, folder, SIGN, "a") == 2 and written(spark, folder) == [(1, "p1"), (2, "p2")]


def test_a_stream_that_is_taken_up_again(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame([(10 * k + j, f"p{j}") for j in range(5)], "id long, pred string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, pred string").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(ledger.appending(folder, SIGN, f"run{k // 2}")).option("checkpointLocation", str(tmp_path / f"check{k // 2}")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [i for i, _ in written(spark, folder)] == [10 * k + j for k in range(4) for j in range(5)]
