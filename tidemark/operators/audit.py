"""Leakage audits of item texts: naive Bayes, AUROC, majority priors, cues, votes and filters."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from heapq import nsmallest

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators.running import cumulated
from tidemark.operators.wordsets import WordSets
from tidemark.sources.tables import checkpointed


def fold_of(group: Column, folds: int = 5) -> Column:
    return F.pmod(X.hash_int(group), F.lit(folds))


def word_set(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z]+")), "")


def words_of(rows: DataFrame, text: Column, group: str, folds: int = 5) -> DataFrame:
    """(id, known, fold, w): the set of each text's words."""
    return rows.select("id", "known", fold_of(F.col(group), folds).alias("_fold"), F.explode(word_set(text)).alias("w"))


def scored_words(items: DataFrame, words: DataFrame) -> DataFrame:
    """(id, known, score) of items (id, known, _fold): out-of-fold log odds of their words.

    A word's counts by fold are one row, with the sums of the others taken from its total, so the words are grouped once and joined once.
    """
    folds = [r[0] for r in items.select("_fold").distinct().orderBy("_fold").collect()]  # five
    if not folds:
        return items.select("id", "known", F.lit(0.0).alias("score"))
    counts = [F.count_if((F.col("_fold") != f) & (F.col("known") == k)).alias(f"{n}{f}") for f in folds for k, n in ((True, "k"), (False, "u"))]
    table = checkpointed(words.groupBy("w").agg(*counts))
    sums = [x for f in folds for x in (F.count_if(F.col(f"k{f}") + F.col(f"u{f}") > 0).alias(f"v{f}"), F.sum(f"k{f}").alias(f"k{f}"), F.sum(f"u{f}").alias(f"u{f}"))]
    total = table.agg(*sums).first()
    docs = {r["_fold"]: (r["k"], r["u"]) for r in items.groupBy("_fold").agg(F.count_if("known").alias("k"), F.count_if(~F.col("known")).alias("u")).collect()}
    every = [sum(d[j] for d in docs.values()) for j in (0, 1)]
    odds, prior = F.lit(0.0), F.lit(0.0)
    for f in folds:
        k, u, v = total[f"k{f}"] or 0, total[f"u{f}"] or 0, total[f"v{f}"]
        own = F.log((F.col(f"k{f}") + 1) / F.lit(float(k + v or 1))) - F.log((F.col(f"u{f}") + 1) / F.lit(float(u + v or 1)))
        odds = F.when(F.col("_fold") == f, F.when(F.col(f"k{f}") + F.col(f"u{f}") > 0, own).otherwise(0.0)).otherwise(odds)
        prior = F.when(F.col("_fold") == f, F.lit(math.log((every[0] - docs[f][0] + 1) / (every[1] - docs[f][1] + 1)))).otherwise(prior)
    summed = words.select("id", "_fold", "w").join(table, "w").groupBy("id").agg(F.sum(odds).alias("s"))
    return items.join(summed, "id", "left").select("id", "known", (F.coalesce("s", F.lit(0.0)) + prior).alias("score"))


def naive_bayes(rows: DataFrame, text: Column, group: str, folds: int = 5) -> DataFrame:
    """Out-of-fold log odds of known against uncertain from the set of a text's words, Laplace-smoothed, vocabulary of the other folds."""
    items = rows.select("id", "known", fold_of(F.col(group), folds).alias("_fold"))
    return scored_words(items, words_of(rows, text, group, folds))


def auroc(scores: DataFrame) -> DataFrame:
    """By ranks, equal scores averaged; null if a class is empty. Scores are grouped first, so equal ones are one row."""
    flat = scores.groupBy("score").agg(F.count_if("known").alias("k"), F.count("*").alias("n"))
    ranked = cumulated(flat, [F.col("score")], upto=F.col("n")).select("k", "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("r"))
    k, n = F.sum("k"), F.sum("n")
    value = (F.sum(F.col("r") * F.col("k")) - k * (k + 1) / 2) / (k * (n - k))
    return ranked.agg(F.round(F.when((k > 0) & (n > k), value), 6).alias("auroc"))


def majority_accuracy(rows: DataFrame, *keys: Column) -> DataFrame:
    """Accuracy of giving each key its commonest answer."""
    counts = rows.groupBy(*keys, "answer").agg(F.count("*").alias("n"))
    best = counts.groupBy(*counts.columns[:-2]).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.round(F.sum("best") / F.sum("n"), 6).alias("accuracy"), F.count("*").alias("keys"))


def cue_hits(rows: DataFrame, cues: DataFrame, text: str) -> DataFrame:
    """Items whose words include a cue, for each cue. Words are joined to cues by equality, so nothing is crossed."""
    words = rows.select("id", "known", F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("cue"))
    return words.join(cues.distinct(), "cue").groupBy("cue").agg(F.count("*").alias("n"), F.count_if("known").alias("n_known"))


def vote_filter(votes: DataFrame, models: int, least: int) -> DataFrame:
    """Items with fewer than `least` correct votes; an item without all its models is an error."""
    per = votes.groupBy("id").agg(F.sum(F.col("correct").cast("int")).alias("votes"), F.countDistinct("model").alias("_m"))
    checked = per.withColumn("votes", F.when(F.col("_m") == models, F.col("votes")).otherwise(F.raise_error(F.concat(F.lit("votes missing for "), F.col("id").cast("string")))))
    return checked.where(F.col("votes") < least).select("id", F.col("votes").cast("long").alias("votes"))


def vote_histogram(votes: DataFrame, models: int) -> DataFrame:
    """How many items have 0 to `models` correct votes, zeros included."""
    per = votes.groupBy("id").agg(F.sum(F.col("correct").cast("int")).alias("votes"))
    every = votes.sparkSession.range(models + 1).select(F.col("id").cast("int").alias("votes"))
    return every.join(per.groupBy(F.col("votes").cast("int").alias("votes")).agg(F.count("*").alias("n")), "votes", "left").select(F.col("votes").cast("long").alias("votes"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Points by which shares may move; a cause's share may also move by 1.5 uncertain rows.
TOLERANCE, STATUS_TOLERANCE = 2.0, 1.5
#: Rows of an order that travel in one piece.
PIECE = 1 << 20


class Balance:
    """How many rows of each category are left, as a vector. Cells are rows with equal categories; `table` has a cell's categories as zeros and ones."""

    def __init__(self, cells: list[dict], step: float):
        names = sorted({c for x in cells for c in self.categories(x)}, key=str)
        place = {c: k for k, c in enumerate(names)}
        self.cells, self.table = cells, np.zeros((len(cells), len(names)), np.int64)
        for k, x in enumerate(cells):
            self.table[k, [place[c] for c in self.categories(x)]] = 1
        self.known = np.array([x["known"] for x in cells], bool)
        many = np.array([x["n"] for x in cells], np.int64)
        self.counts, self.n, self.uncertain = many @ self.table, int(many.sum()), int(many[~self.known].sum())
        self.of_causes = np.array([c[0] == "cause" for c in names], bool)
        self.ratio = (self.n - self.uncertain) / max(self.uncertain, 1)
        sizes: Counter = Counter()
        for x in cells:
            if not x["known"]:
                sizes[x["question_type"]] += x["n"]
        self.quota = {t: max(1, round(step * n)) for t, n in sizes.items()}
        causes = max(TOLERANCE, 150 / max(self.uncertain, 1))
        self.limits = np.array([STATUS_TOLERANCE if c[0] == "status" else causes if c[0] == "cause" else TOLERANCE for c in names])
        self.first = self.percent(self.counts, self.n, self.uncertain)

    @staticmethod
    def categories(cell: dict) -> list[tuple]:
        own = [("status", cell["known"]), *((c, cell[c]) for c in ("question_type", "intensity", "age"))]
        return own if cell["known"] else own + [("cause", c) for c in cell["causes"]]

    def percent(self, counts: np.ndarray, n: int, uncertain: int) -> np.ndarray:
        return 100 * counts / np.where(self.of_causes, max(uncertain, 1), n)

    def drop(self, cells: list[int]) -> bool:
        """Takes one row out of each of these cells if all shares stay within their limits of `first`."""
        left, n = self.counts - self.table[cells].sum(0), self.n - len(cells)
        uncertain = self.uncertain - int((~self.known[cells]).sum())
        if n <= 0 or (np.abs(self.percent(left, n, uncertain) - self.first) > self.limits).any():
            return False
        self.counts, self.n, self.uncertain = left, n, uncertain
        return True


def falling(balance: Balance, order: Iterable[np.ndarray], partners: dict[int, list[tuple]]) -> tuple[list[int], list]:
    """(places in the order, ids of partners) that a round drops.

    order gives the cells of uncertain rows, most identifiable first; partners the (-score, id) of the known rows of a cell, least identifiable first. An uncertain
    row takes as many known ones of its type along as the ratio asks for: equal intensity before equal age before any, then by score.
    """
    used, falls, places, ids, at = Counter(), 0, [], [], 0
    quota, ratio = dict(balance.quota), balance.ratio
    by_type: dict = {}
    for k in partners:
        by_type.setdefault(balance.cells[k]["question_type"], []).append(k)
    tiers: dict[int, list[list[int]]] = {}
    refused: set[int] = set()  # cells that can lose no row until another falls

    def tiers_of(own: int) -> list[list[int]]:
        cell, near = balance.cells[own], {}
        for k in by_type.get(cell["question_type"], []):
            near.setdefault((cell["intensity"] != balance.cells[k]["intensity"], cell["age"] != balance.cells[k]["age"]), []).append(k)
        return [near[x] for x in sorted(near)]

    for piece in order:
        for own in piece.tolist():
            at += 1
            if own in refused:
                continue
            kind = balance.cells[own]["question_type"]
            if not quota[kind]:
                continue
            need = round((falls + 1) * ratio) - round(falls * ratio)
            if own not in tiers:
                tiers[own] = tiers_of(own)
            heads: list[tuple] = []
            for tier in tiers[own]:
                if len(heads) < need:
                    heads += nsmallest(need - len(heads), ((*x, k) for k in tier for x in partners[k][used[k] : used[k] + need - len(heads)]))
            if len(heads) == need and balance.drop([own, *(x[-1] for x in heads)]):
                used.update(x[-1] for x in heads)
                ids += [x[-2] for x in heads]
                places.append(at - 1)
                quota[kind] -= 1
                falls += 1
                refused.clear()
            else:
                refused.add(own)
        if not any(quota.values()):
            break
    return places, ids


def debias(rows: DataFrame, text: Column, group: str, intensity: Column, age: Column, causes: Column | None = None, target: float = 0.65, keep: float = 0.65, step: float = 0.03) -> DataFrame:
    """Drops the most identifiable uncertain items with known ones of their type, while shares hold, until the AUROC of the words falls to the target,
    the share to keep is reached or no item can fall.

    Texts are taken apart once, into packed sets of words (wordsets.py); ranks and joins are relational. Ids are unique. Whether an item falls depends on those before
    it, so that step is a walk over the order of uncertain rows as numbers of cells (two bytes a row, PIECE rows at a time through the driver) with, for each cell of known rows, as many of its first as the quotas could ask
    for. The score is the log odds of known: the lowest look most uncertain.
    """
    none = F.array().cast("array<string>")
    bins = rows.select("id", "known", "question_type", intensity.alias("intensity"), age.alias("age"), (none if causes is None else F.array_sort(F.array_distinct(F.coalesce(causes, none)))).alias("causes"), fold_of(F.col(group)).alias("_fold"), word_set(text).alias("words"))
    bins = bins.where("id is not null").withColumn("causes", F.when(~F.col("known"), F.col("causes")).otherwise(none))
    kinds = ["known", "question_type", "intensity", "age", "causes"]
    cells = [r.asDict() for r in bins.groupBy(*kinds).agg(F.count("*").alias("n")).orderBy(*kinds).collect()]  # cells, whatever the number of rows
    if not cells:
        return rows
    numbered = rows.sparkSession.createDataFrame([tuple(x[k] for k in kinds) + (k,) for k, x in enumerate(cells)], bins.select(*kinds).schema.add("cell", "integer"))
    equal = [bins[k].eqNullSafe(numbered[k]) for k in kinds]
    items = bins.join(F.broadcast(numbered), reduce(lambda a, b: a & b, equal)).select("id", bins["known"], "cell", "_fold", "words")
    sets = WordSets(items)
    whole, first = Balance(cells, step), None
    while True:
        scores = checkpointed(sets.scores())
        many = {r["cell"]: r["n"] for r in scores.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        value = auroc(scores).first()["auroc"]
        if value is None or value <= target or sum(many.values()) <= keep * whole.n:
            break
        balance = Balance([x | {"n": many.get(k, 0)} for k, x in enumerate(cells)], step)
        balance.first = first = balance.first if first is None else first
        balance.limits = whole.limits
        order = cumulated(scores.where("not known"), [F.col("score"), F.col("id")], place=F.lit(1)).withColumn("place", F.col("place") - 1)
        order = checkpointed(order)
        pieces = order.groupBy(F.floor(F.col("place") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("place", "cell"))).alias("rows"))
        walk = (np.fromiter((x["cell"] for x in r["rows"]), np.int16) for r in pieces.orderBy("piece").toLocalIterator())
        # a type's uncertain rows take no more than these along
        most = {t: min(math.ceil(sum(balance.quota.values()) * balance.ratio) + 1, n * (math.floor(balance.ratio) + 1)) for t, n in balance.quota.items()}
        asked = rows.sparkSession.createDataFrame([(k, most.get(x["question_type"], 0)) for k, x in enumerate(cells) if x["known"]] or [(-1, 0)], "cell int, most long")
        ranked = scores.where("known").withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy(F.desc("score"), "id")))
        ranked = ranked.where(F.col("r") <= max(most.values(), default=0)).join(F.broadcast(asked), "cell").where(F.col("r") <= F.col("most"))
        partners: dict[int, list[tuple]] = {}
        for r in ranked.orderBy("cell", "r").toLocalIterator():
            partners.setdefault(r["cell"], []).append((-r["score"], r["id"]))
        places, ids = falling(balance, walk, partners)
        if not places:
            break
        spark, kind = rows.sparkSession, scores.select("id").schema
        taken = scores.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], kind)), "id")
        fell = order.join(F.broadcast(spark.createDataFrame([(p,) for p in places], "place long")), "place")
        sets.drop(fell.select("chunk", "row").unionByName(taken.select("chunk", "row")))
    return rows.join(scores.select("id"), "id", "left_semi")
