"""Each rule of a contract on a row made to break it."""

from tidemark.operators import contracts
from tidemark.operators.items import ABSTENTION

ROW = {"id": "q1", "options": ["a", "b", "c", ABSTENTION], "answer_index": 1, "abstention_index": 3, "status": "known", "uncertainty_sources": [], "evidence_spans": [[0.0, 2.0]], "query_time": 5.0, "change_intensity": 3}
SCHEMA = "id string, options array<string>, answer_index int, abstention_index int, status string, uncertainty_sources array<string>, evidence_spans array<array<double>>, query_time double, change_intensity int"
BROKEN = [
    ({"id": "unknown7"}, "id without a status word"), ({"status": "maybe"}, "status"), ({"abstention_index": 2}, "abstention in its place"), ({"options": ["a", "b", ABSTENTION, "c"]}, "abstention in its place"), ({"options": ["a", " A ", "c", ABSTENTION]}, "options differ"),
    ({"options": ["a", "  ", "c", ABSTENTION]}, "options differ"), ({"options": ["a", "cannot be determined", "c", ABSTENTION]}, "substantive wording"), ({"status": "uncertain", "uncertainty_sources": ["x"]}, "uncertain answer abstains"), ({"answer_index": 3}, "known answer is substantive"),
    ({"uncertainty_sources": ["x"]}, "sources fit the status"), ({"status": "uncertain", "answer_index": 3}, "sources fit the status"), ({"evidence_spans": [[0.0, 6.0]]}, "evidence before the question"), ({"change_intensity": 11}, "intensity"), ({"change_intensity": None}, "intensity"),
]


def test_released_rows(spark):
    good = [ROW, ROW | {"id": "q2", "status": "uncertain", "answer_index": 3, "uncertainty_sources": ["x"], "evidence_spans": None}]
    rows = good + [ROW | {"id": f"r{k}"} | change for k, (change, _) in enumerate(BROKEN)] + [ROW | {"id": "twice"}, ROW | {"id": "twice"}]
    got = {(r.id, r.rule) for r in contracts.released_violations(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).collect()}
    for k, (change, rule) in enumerate(BROKEN):
        assert (change.get("id", f"r{k}"), rule) in got
    assert ("twice", "unique id") in got and not {i for i, _ in got} & {"q1", "q2"}
    assert {rule for _, rule in got} == {*contracts.released_rules(), "unique id"}


NO = "It cannot be told."
FILES = {
    "questions": "id string, episode_id string, query_time double, question_type string, question_subtype string, status string, change_intensity int, question string, question_stem string, options array<string>, answer_index int, evidence_spans array<array<double>>",
    "truth": "id string, episode_id string, query_time double, question_type string, question_subtype string, status string, change_intensity int, answer int, source_answer_index int, option_permutation array<int>, options array<string>, question string, question_stem string, video_path string",
    "inputs": "id string, episode_id string, video_path string, query_time double, question string, question_stem string, options array<string>",
    "provenance": "id string, duration double, observations array<double>", "labels": "id string, answer_index int, status string, question_type string", "videos": "episode_id string, video_path string", "splits": "split string, id string", "mirrors": "episode_id string, id string",
}


def bundle():
    out = {name: [] for name in FILES}
    for k in range(8):
        e, i, status, answer = f"e{k // 4}", f"q{k}", "uncertain" if k % 4 == 3 else "known", k % 4
        options = ["a", "b", "c", NO]
        stem = f"Video.\nQuestion: Where {k}?"
        text = stem + "\nOptions:\n" + "\n".join(f"{x}. {o}" for x, o in zip("ABCD", options, strict=True)) + "\nAnswer with one option letter."
        same = {"episode_id": e, "query_time": 5.0, "question_type": "t", "question_subtype": None, "status": status, "change_intensity": 2}
        out["questions"].append({"id": i, **same, "question": f"Where {k}?", "question_stem": stem, "options": options, "answer_index": answer, "evidence_spans": [[0.0, 4.0]]})
        out["truth"].append({"id": i, **same, "answer": answer, "source_answer_index": answer, "option_permutation": [0, 1, 2, 3], "options": options, "question": text, "question_stem": stem, "video_path": f"videos/{e}.mp4"})
        out["inputs"].append({c: out["truth"][-1][c] for c in contracts.SHOWN})
        out["provenance"].append({"id": i, "duration": 9.0, "observations": [1.0, 4.0]})
        out["labels"].append({"id": i, "answer_index": answer, "status": status, "question_type": "t"})
        out["splits"].append({"split": "primary_visual_known" if status == "known" else "epistemic_uncertain", "id": i})
        out["mirrors"].append({"episode_id": e, "id": i})
    out["videos"] = [{"episode_id": e, "video_path": f"videos/{e}.mp4"} for e in ("e0", "e1")]
    return out


def broken(spark, changes):
    """What the contract finds in bundles with one change each, put together: ids and episodes of bundle k begin with k."""
    whole = {name: [] for name in FILES}
    for k, change in enumerate(changes):
        own = bundle()
        change(own)
        for name, rows in own.items():
            whole[name] += [r | {c: f"{k} {r[c]}" for c in ("id", "episode_id") if c in r} for r in rows]
    frames = [spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in whole[name]], schema) for name, schema in FILES.items()]
    return {(r.id, r.rule) for r in contracts.export_violations(*frames, NO, each=4).collect()}


def put(file, field, value, row=0):
    return lambda own: own[file][row].__setitem__(field, value)


CASES = [
    (put("questions", "options", ["a", "a", "c", NO]), ("q0", "options")), (put("questions", "answer_index", 4), ("q0", "answer index")), (put("questions", "options", ["a", "b", "c", "d"], 3), ("q3", "abstention among the options")), (put("questions", "status", "x"), ("q0", "status")),
    (put("questions", "answer_index", 0, 3), ("q3", "abstention fits the status")), (put("truth", "answer", 2), ("q0", "answers agree")), (put("labels", "answer_index", 2), ("q0", "answers agree")), (put("truth", "option_permutation", [1, 0, 2, 3]), ("q0", "options in their order")),
    (put("truth", "options", ["b", "a", "c", NO]), ("q0", "options agree")), (put("truth", "query_time", 6.0), ("q0", "query_time agrees")), (put("truth", "question_subtype", "s"), ("q0", "question_subtype agrees")), (put("labels", "question_type", "u"), ("q0", "labels agree")), (put("truth", "question_stem", "other"), ("q0", "stem")),
    (put("truth", "question", "other"), ("q0", "prompt")), (put("inputs", "question", "other"), ("q0", "public fields")), (put("provenance", "duration", 5.0), ("q0", "time inside the video")), (put("questions", "evidence_spans", [[3.0, 6.0]]), ("q0", "causal evidence")), (put("questions", "evidence_spans", []), ("q0", "causal evidence")),
    (put("provenance", "observations", [1.5]), ("q0", "causal, sampled observations")), (put("provenance", "observations", [7.0]), ("q0", "causal, sampled observations")), (put("truth", "video_path", "/abs/e0.mp4"), ("q0", "portable video path")), (put("truth", "video_path", "videos/../e0.mp4"), ("q0", "portable video path")),
    (put("truth", "video_path", "videos/e1.mp4"), ("q0", "video of its episode")), (put("splits", "split", "epistemic_uncertain"), ("q0", "split")), (lambda own: own["truth"].pop(), ("q7", "in truth")), (lambda own: own["labels"].append(own["labels"][0]), ("q0", "once in labels")),
    (lambda own: own["inputs"].append(own["inputs"][0] | {"id": "q9"}), ("q9", "inputs without a question")), (lambda own: own["videos"].append(own["videos"][0]), ("e0", "one video an episode")), (lambda own: own["videos"].pop(), ("e1", "video of an episode")), (lambda own: own["mirrors"].pop(), ("q7", "mirror")),
    (lambda own: own["questions"].pop(), ("e1", "questions an episode")), (put("questions", "answer_index", 1), (None, "positions in balance")), (lambda own: own["videos"].append({"episode_id": "e5", "video_path": "x"}), ("e5", "video without questions")),
]


def test_good_exports(spark):
    assert broken(spark, [lambda own: None] * 2) == set()
    assert broken(spark, []) == {(None, "rows")}


def test_broken_exports(spark):
    found = broken(spark, [change for change, _ in CASES])
    for k, (_, (where, rule)) in enumerate(CASES):
        assert (where if where is None else f"{k} {where}", rule) in found, rule


def test_segments(spark):
    rows = [(1, "v", 0, 5, "cook", "x"), (2, "v", 5, 9, "cook", "x"), (3, "v", 10, 12, "cook", "x"), (4, "w", 3, 3, "cook", "x"), (5, "w", 3, 8, "other", None), (6, None, 0, 1, "cook", "x")]
    got = {(r.id, r.rule) for r in contracts.segment_violations(spark.createDataFrame(rows, "id long, video string, start long, end long, role string, activity string"), ["cook"], ["x"]).collect()}
    assert got == {(3, "follows the one before"), (4, "length"), (5, "role"), (5, "activity"), (6, "video")}
