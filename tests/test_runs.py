"""Choices, errors on unknown ids, resumed runs, running sums, backups and boundaries."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import audit, distribution, motion, runs, scoring, sets
from tidemark.operators.running import cumulated
from tidemark.sources import records


@pytest.mark.parametrize(("text", "choice"), [
    ("A", "A"), ("答案：C", "C"), ("The answer is (D).", "D"), ("<think>Option A looks possible.</think><answer>C</answer>", "C"), ("无法判断", None),
    ("A dog is there, so answer: B", "B"), ("i think b", "B"), ("I pick d.", "D"), ("  (b) it is", "B"), ("<answer>so it is\nC then</answer>", "C"), ("选A吧", None), ("no idea", None), ("E", None), (None, None),
])
def test_choices(spark, text, choice):
    assert spark.createDataFrame([(text,)], "t string").select(X.extract_choice(F.col("t"), 4)).first()[0] == choice


def test_unknown_ids_are_errors(spark):
    items = spark.createDataFrame([(1, 0, 3, True)], "id long, answer int, abstention_index int, known boolean")
    with pytest.raises(PySparkException, match="unknown id: 2"):
        scoring.summary(scoring.outcomes(items, spark.createDataFrame([(2, 0)], "id long, pred_index int"))).collect()
    rows, edits = spark.createDataFrame([(1, "a b")], "id long, t string"), spark.createDataFrame([(1, 1, "a", "c"), (2, 1, "a", "c")], "id long, seq long, old string, new string")
    with pytest.raises(PySparkException, match="unknown id: 2"):
        sets.applied_edits(rows, edits, "t").collect()
    assert sets.applied_edits(rows, edits.where("id = 1"), "t").first().t == "c b"


def test_intervals_need_two_clusters(spark):
    rows = [(e, k % 2 == 0, k % 3 == 0, k % 5 == 0, 1) for e in "ab" for k in range(6)]
    outs = spark.createDataFrame(rows, "episode string, known boolean, correct boolean, abstained boolean, er int")
    assert scoring.bootstrap_measures(outs.where("episode = 'a'"), "episode", 50).count() == 0
    assert {r.measure for r in scoring.bootstrap_measures(outs, "episode", 50).collect()} == {"er", "h", "ka", "ar", "accuracy"}
    assert {r.measure for r in scoring.bootstrap_measures(outs.where("known"), "episode", 50).collect()} == {"er", "ka", "accuracy"}


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(100)) for k in range(3000)]
    got = cumulated(spark.createDataFrame(rows, "k long, v long").repartition(7), [F.desc("k")], total=F.col("v"), rank=F.lit(1)).collect()
    want, total = {}, 0
    for rank, (k, v) in enumerate(sorted(rows, reverse=True), 1):
        total += v
        want[k] = (total, rank)
    assert {r.k: (r.total, r["rank"]) for r in got} == want


def test_auroc_and_thresholds(spark):
    rows = [(0.1, False, False), (0.4, True, True), (0.4, False, False), (0.8, True, False), (0.9, True, True)]
    scores = spark.createDataFrame(rows, "score double, known boolean, correct boolean")
    pairs = [(a, b) for a, k, _ in rows if k for b, u, _ in rows if not u]
    assert audit.auroc(scores).first().auroc == round(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs), 6)
    assert audit.auroc(scores.where("known")).first().auroc is None
    flipped = scores.withColumn("score", -F.col("score"))
    assert tuple(scoring.blind_threshold(flipped).first()) == (-0.1, 0.571429)


def test_resumed_and_limited(spark):
    rows = spark.createDataFrame([(k, f"e{k % 3}") for k in range(9)], "id long, e string")
    done = spark.createDataFrame([(2, "s"), (5, "s")], "id long, signature string")
    assert [r.id for r in runs.pending(rows, done, "s").orderBy("id").collect()] == [0, 1, 3, 4, 6, 7, 8]
    with pytest.raises(PySparkException, match="different configuration"):
        runs.pending(rows, done, "t").collect()
    assert [r.id for r in runs.first_rows(rows, 2, F.desc("id")).collect()] == [8, 7]
    assert runs.some_groups(rows, "e", 2, 1).select("e").distinct().count() == 2


def test_fingerprints_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, v string")
    digest = lambda df: distribution.fingerprint(df, "id").first().digest
    assert digest(rows) == digest(rows.orderBy(F.desc("id")).select("v", "id")) != digest(rows.na.fill("")) != digest(rows.limit(0))
    one, two = (records.write_snapshot(df, str(tmp_path), "id") for df in (rows, rows.withColumn("v", F.lit("new"))))
    assert one != two and spark.read.parquet(f"{tmp_path}/{two}").where("v = 'new'").count() == 3


def test_rewrite_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "rows")
    records.write_lines(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), path)
    kept = records.rewrite_with_backup(spark, path, lambda df: df.withColumn("v", F.upper("v")), "1")
    assert {r.v for r in spark.read.json(path).collect()} == {"A", "B"} and {r.v for r in spark.read.json(kept).collect()} == {"a", "b"}
    with pytest.raises(FileExistsError):
        records.rewrite_with_backup(spark, path, lambda df: df, "1")


def test_boundaries_and_types(spark):
    row = spark.createDataFrame([(2.53, [0.0, 2.5, 5.0], "state_change", "toggle")], "v double, b array<double>, kind string, action string")
    assert row.select(X.boundary(F.col("v"), F.col("b"))).first()[0] == 2.5
    with pytest.raises(PySparkException, match="not aligned"):
        row.select(X.boundary(F.col("v") + 1, F.col("b"))).collect()
    assert tuple(row.select(X.event_labels(F.col("kind"), F.col("action"), F.lit(False))).first()[0]) == ("state_change", "toggle_off")
    with pytest.raises(PySparkException, match="unknown event type"):
        row.select(X.event_labels(F.lit("fly"), F.col("action"), F.lit(None).cast("boolean"))).collect()


def test_exits_need_two_samples(spark):
    states = ["visible", "visible", "absent", "visible", "visible", "ambiguous", "absent", "absent", "absent", "visible", "visible", "absent", "absent"]
    rows = spark.createDataFrame([("o", t, s) for t, s in enumerate(states)], "o string, t long, s string")
    assert [r.t for r in motion.exits(rows, ["o"], "t", "s").orderBy("t").collect()] == [7, 12]
