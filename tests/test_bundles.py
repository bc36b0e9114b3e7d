"""Bundles of a run: good ones as written, each fault by its name."""

import json

import pytest

from tidemark.sources.bundles import accepted_bundles, bundle_faults


def write(root, name, plan="p", accepted=True, trace_accepted=True, failed=(), leave_out=None, broken=None):
    folder = root / name
    folder.mkdir(parents=True)
    parts = {"episode_validation": {"accepted": accepted}, "execution_trace": {"accepted": trace_accepted, "failed_frames": list(failed), "steps": [1, 2]}, "episode_plan": {"plan_id": plan}, "scene_profile": {"rooms": ["é\n"]}, "notes": {"x": 1}}
    for part, content in parts.items():
        if part != leave_out:
            (folder / f"{part}.json").write_text("[1" if part == broken else json.dumps(content, indent=1))


def test_bundles(spark, tmp_path):
    run = tmp_path / "run of 1"
    faults = {
        "a/good": None, "good": None, "late": "not accepted", "trace": "not accepted", "frames": "failed frames", "other": "plan id differs from the manifest",
        "short": "scene_profile.json is missing", "broken": "episode_plan.json is no JSON object", "absent": "episode_validation.json is missing",
    }
    for name in ("a/good", "good", "outside"):
        write(run, name)
    write(run, "late", accepted=False)
    write(run, "trace", trace_accepted=False, failed=[3])
    write(run, "frames", failed=[3])
    write(run, "other", plan="q")
    write(run, "short", leave_out="scene_profile")
    write(run, "broken", broken="episode_plan")
    manifest = spark.createDataFrame([*[(d, "p", "x") for d in faults], ("good", "p", "x"), (None, "p", "x")], "directory string, plan_id string, trace string")
    got = {r.directory: r for r in bundle_faults(spark, str(run), manifest).collect()}
    assert {d: r.fault for d, r in got.items()} == faults
    good = manifest.where("directory in ('good', 'a/good')")
    rows = accepted_bundles(spark, str(run), good).collect()
    assert sorted(r.directory for r in rows) == ["a/good", "good"]
    assert all(json.loads(r.profile) == {"rooms": ["é\n"]} and json.loads(r.trace)["steps"] == [1, 2] and json.loads(r.plan)["plan_id"] == r.plan_id for r in rows)
    with pytest.raises(Exception, match="frames: failed frames"):
        accepted_bundles(spark, str(run), manifest.where("directory in ('good', 'frames')")).collect()
    assert accepted_bundles(spark, str(run), manifest.limit(0)).collect() == []
