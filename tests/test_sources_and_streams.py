import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import records
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"


def test_arrays_lines_and_empty_files(spark, tmp_path):
    rows = [{"id": "a", "options": ["x", "y"], "evidence_spans": [[1.0, 2.5]]}, {"id": "b", "diagnostics": {"epistemic_status": "known", "uncertainty_sources": []}}]
    (tmp_path / "array.json").write_text("\n " + json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("\n".join(["", *map(json.dumps, rows), "", ""]))
    (tmp_path / "empty.jsonl").write_text("\n")
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n[1, 2\n')
    for name in ("array.json", "lines.jsonl"):
        assert sorted(r.id for r in records.read_records(spark, str(tmp_path / name)).collect()) == ["a", "b"]
    assert records.read_records(spark, str(tmp_path / "empty.jsonl")).count() == 0
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_keyed_and_sharded(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "question": "old"}\n{"id": "1", "question": "new"}\n')
    assert [r.question for r in records.read_keyed(spark, str(tmp_path / "a.jsonl"), records.ITEM).collect()] == ["new"]
    with pytest.raises(Exception, match="repeated id"):
        records.read_predictions(spark, [str(tmp_path / "a.jsonl")], records.ITEM).collect()


def test_results_edits_documents_and_media(spark, tmp_path):
    where = tmp_path / "cook/models/online/m1"
    where.mkdir(parents=True)
    (where / "result.json").write_text('{"h": 0.5}')
    got = records.read_results(spark, str(tmp_path / "*/models/*/*/result.json"), "h double").first()
    assert (got.subset, got.protocol, got.model, got.h) == ("cook", "online", "m1", 0.5)
    (tmp_path / "01.json").write_text('[{"id": "1", "field": "question", "old": "a", "new": "b"}]')
    assert records.read_edits(spark, str(tmp_path / "0*.json")).first().source_file == "01.json"
    (tmp_path / "doc.json").write_text('{"episode_id": "e", "questions": [{"id": "1"}, {"id": "2"}]}')
    assert records.read_documents(spark, str(tmp_path / "doc.json"), "id: string").count() == 2
    (where / "v.mp4").write_bytes(b"123")
    assert [r.length for r in records.find_media(spark, str(tmp_path)).collect()] == [3]


def test_text_scans(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("Time Hips x2 x3 Head\n0 1.5 2 3 9\n1 4 5 6 9\n")
    assert [tuple(r) for r in records.read_poses(spark, str(tmp_path / "poses.txt"), "Hips").collect()] == [(1.5, 2, 3), (4, 5, 6)]
    (tmp_path / "acts.txt").write_text("walk 1 5 ok\nbad x 5 ok\nshort 1\n")
    assert [tuple(r) for r in records.read_actions(spark, str(tmp_path / "acts.txt")).collect()] == [("walk", 1, 5, "ok")]


def test_frame_grids(spark):
    video = spark.createDataFrame([("v", 100, 30.0)], "id string, frames long, source_fps double")
    assert [r.frame for r in records.frame_grid(video, 1.0).collect()] == [0, 30, 60, 90]
    assert [r.frame for r in records.frame_linspace(video, F.lit(4)).collect()] == [0, 33, 66, 99]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "q", 2, 0.5)], "id string, question string, answer int, score double")
    records.write_public_private(records.finite(rows), str(tmp_path / "out"), ["id", "question"])
    assert "answer" not in spark.read.json(str(tmp_path / "out/questions")).columns
    assert spark.read.json(str(tmp_path / "out/labels")).first().answer == 2
    assert records.write_snapshot(rows, str(tmp_path / "snap"), "id") == records.write_snapshot(rows, str(tmp_path / "snap"), "id")
    with pytest.raises(Exception, match="not finite"):
        records.finite(rows.withColumn("score", F.lit(float("nan")))).collect()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_to_memory(streams.tumbling_counts(streams.event_stream(spark, SF), "1 hour", "event_type"), "tumbling", str(tmp_path / "c1"))
    last = events.agg(F.max("ts")).first()[0]
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).where(F.col("window.end") <= F.lit(last))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(*out.columns).collect()))
    out = streams.run_to_memory(streams.session_counts(streams.event_stream(spark, SF), "12 hours", "user_id"), "sessions", str(tmp_path / "c2"))
    got = {(r.user_id, r.session_window.start, r.n) for r in out.collect()}
    want = events.groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n")).collect()
    newest = {}
    for r in want:
        newest[r.user_id] = max(newest.get(r.user_id, r.session_window.start), r.session_window.start)
    assert got <= {(r.user_id, r.session_window.start, r.n) for r in want}
    withheld = [r for r in want if (r.user_id, r.session_window.start, r.n) not in got]
    assert all(r.session_window.start == newest[r.user_id] for r in withheld)  # a key's newest session may still be open


def test_window_state(spark, tmp_path):
    out = streams.run_to_memory(streams.windows_kept(streams.event_stream(spark, SF), "user_id", "value", 3), "kept", str(tmp_path / "c3"), "update")
    for r in out.collect():
        own = [x.value for x in spark.read.parquet(f"{SF}/events.parquet").where(f"user_id = {r.episode}").orderBy("event_id").collect()] if r.episode < 5 else None
        if own is not None:
            assert r.kept == own[-3:] and r.seen == len(own) and r.evicted == max(0, len(own) - 3)


def test_prefix_frames(spark):
    frames = spark.createDataFrame([("e", float(k)) for k in range(10)], "k string, t double")
    asks = spark.createDataFrame([("e", "a", 3.0), ("e", "b", 6.5)], "k string, id string, query_time double")
    got = sorted((r.id, r.t) for r in streams.prefix_frames(frames, asks, "k").collect())
    assert got == [("a", float(k)) for k in range(4)] + [("b", float(k)) for k in range(4, 7)]
