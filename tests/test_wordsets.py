"""Packed sets of words against the relational form, before and after items fall; a walk that asks a refused cell once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, wordsets


@pytest.mark.parametrize("chunk", [40, 1 << 22])
def test_scores_equal_those_of_joined_words(spark, monkeypatch, chunk):
    monkeypatch.setattr(wordsets, "CHUNK", chunk)
    rng = random.Random(9)
    rows = [(i, rng.choice([True, True, False]), f"g{i % 7}", " ".join(rng.choices(["Sure", "seen", "x", f"w{chr(97 + i % 26)}", "maybe"], k=i % 6))) for i in range(300)]
    rows += [(900, None, "g1", "sure seen"), (901, True, None, "sure maybe"), (902, False, "g2", None), (903, True, "g3", "seen sure"), (904, True, "g3", "sure, SEEN")]
    data = spark.createDataFrame(rows, "id long, known boolean, group string, text string").repartition(3)
    sets = wordsets.WordSets(data.select("id", "known", F.lit(0).alias("cell"), audit.fold_of(F.col("group")).alias("_fold"), audit.word_set(F.col("text")).alias("words")))
    left = data
    for gone in ([], list(range(0, 300, 3)), [1, 2, 902], [i for i, r in enumerate(rows[:300]) if r[2] == "g4"]):
        found = sets.scores() if not gone else None
        if gone:
            sets.drop(sets.scores().where(F.col("id").isin(gone)))
            found, left = sets.scores(), left.where(~F.col("id").isin(gone))
        got = {r.id: (r.known, r.score) for r in found.collect()}
        want = {r.id: (r.known, r.score) for r in audit.naive_bayes(left, F.col("text"), "group").collect()}
        assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
        assert all(got[i][1] == pytest.approx(s, abs=1e-9) for i, (_, s) in want.items())
        assert got[903][1] == got[904][1]  # equal sets of one fold, to the last bit


def test_a_refused_cell_is_asked_once_until_another_row_falls(monkeypatch):
    asked = []
    inner = audit.Balance.drop
    monkeypatch.setattr(audit.Balance, "drop", lambda self, cells: asked.append(cells[0]) or inner(self, cells))
    base = {"intensity": "low", "age": "new", "causes": []}
    cells = [base | {"known": k, "question_type": t, "n": 5} for t in "ab" for k in (True, False)]
    assert audit.falling(audit.Balance(cells, 0.03), [np.array([1, 3] * 500)], {0: [(0.0, 1)], 2: [(0.0, 2)]}) == ([], [])
    assert asked == [1, 3]
