"""Shards of a run put together."""

import json

import pytest

from tidemark.sources import shards

SCHEMA = "id string, pred_index int, signature string, frames long"


def put(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


def row(i, pred, sign="s", frames=8):
    return {"id": i, "pred_index": pred, "signature": sign, "frames": frames, "extra": 1}


def test_merging_counts_and_scores(spark, tmp_path):
    put(tmp_path, "pred_3_0.jsonl", row("b", 0), row("c", None))
    put(tmp_path, "pred_3_2.jsonl", row("a", 3, frames=9))
    put(tmp_path, "pred_1_0.jsonl", row("z", 1))
    target = str(tmp_path / "out")
    got = shards.merge_shards(spark, str(tmp_path), 3, SCHEMA, target, signature="signature", seen="frames").first()
    assert (got["count"], got.missing_shards, got.most_frames_seen) == (3, [1], 9)
    assert [r.id for r in spark.read.json(target).collect()] == ["a", "b", "c"] and "shard" not in spark.read.json(target).columns
    items = spark.createDataFrame([("a", False, 3, 3), ("b", True, 0, 3), ("c", True, 1, 3)], "id string, known boolean, answer int, abstention_index int")
    scored = shards.merge_shards(spark, str(tmp_path), 3, SCHEMA, target, items).first()
    assert scored["count"] == 3 and scored.n == 3 and scored.ar == 1.0 and scored.ka == 0.5


def test_faults(spark, tmp_path):
    target = str(tmp_path / "out")
    with pytest.raises(Exception, match="pred_2_"):
        shards.merge_shards(spark, str(tmp_path), 2, SCHEMA, target)
    put(tmp_path, "pred_2_0.jsonl", row("a", 0))
    put(tmp_path, "pred_2_1.jsonl", row("b", 0, "other"))
    with pytest.raises(ValueError, match="two configurations"):
        shards.merge_shards(spark, str(tmp_path), 2, SCHEMA, target, signature="signature")
    put(tmp_path, "pred_2_1.jsonl", row("a", 1))
    with pytest.raises(Exception, match="a"):
        shards.merge_shards(spark, str(tmp_path), 2, SCHEMA, target)
    put(tmp_path, "pred_2_1.jsonl", row(None, 1))
    with pytest.raises(Exception, match="no id"):
        shards.merge_shards(spark, str(tmp_path), 2, SCHEMA, target)
