"""The contracts of released rows and of an export's files, as named rules; all that is broken comes out as (id, rule).

Defined results: a null in a field that a rule reads breaks the rule; rules on the whole table (unique ids, balance) name the rows at fault, or stand on a row without an id where no
single row is; empty tables break 'rows' of an export and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import items, rules


def released_rules(abstention: str = items.ABSTENTION, options: int = 4) -> dict[str, Column]:
    """Rules of a released row: id, options, answer_index, abstention_index, status, uncertainty_sources, evidence_spans (arrays of two), query_time, change_intensity.

    The abstention is the last option of all rows.
    """
    last, own = options - 1, F.col("options")
    answer, uncertain = F.col("answer_index"), F.col("status") == "uncertain"
    plain = F.transform(own, lambda o: F.lower(F.trim(o)))
    return {
        "id without a status word": ~F.lower("id").rlike("known|uncertain|supp"),
        "status": F.col("status").isin("known", "uncertain"),
        "abstention in its place": (F.size(own) == options) & (F.try_element_at(own, F.lit(options)) == abstention) & (F.col("abstention_index") == last),
        "options differ": (F.size(F.array_distinct(plain)) == options) & F.forall(plain, lambda o: o != ""),
        "substantive wording": F.forall(F.slice(own, 1, last), lambda o: ~items.is_meta(o)),
        "uncertain answer abstains": ~uncertain | (answer == last),
        "known answer is substantive": (F.col("status") != "known") | answer.between(0, last - 1),
        "sources fit the status": uncertain == (F.coalesce(F.size("uncertainty_sources"), F.lit(0)) > 0),
        "evidence before the question": F.forall(F.coalesce("evidence_spans", F.array().cast("array<array<double>>")), lambda s: (s[0] >= 0) & (s[1] <= F.col("query_time") + 1e-6)),
        "intensity": F.col("change_intensity").between(1, 10),
    }


def released_violations(rows: DataFrame, abstention: str = items.ABSTENTION) -> DataFrame:
    """(id, rule) of released rows, repeated ids too (once an id)."""
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("unique id").alias("rule"))
    return rules.violations(rows, released_rules(abstention)).unionByName(again)


def prompt(stem: Column, options: Column) -> Column:
    """A stem with its lettered options and the instruction."""
    lines = F.transform(options, lambda o, k: F.concat(F.chr(k + 65), F.lit(". "), o))
    return F.concat(stem, F.lit("\nOptions:\n"), F.array_join(lines, "\n"), F.lit("\nAnswer with one option letter."))


SAME = ("episode_id", "query_time", "question_type", "question_subtype", "status", "change_intensity")
SHOWN = ("id", "episode_id", "video_path", "query_time", "question", "question_stem", "options")


def export_violations(
    questions: DataFrame, truth: DataFrame, inputs: DataFrame, provenance: DataFrame, labels: DataFrame, videos: DataFrame, splits: DataFrame, mirrors: DataFrame, abstention: str, each: int = 10, positions: int = 4,
) -> DataFrame:
    """(id, rule) of an export's seven files and its mirrors, which must hold the same questions.

    questions: id, SAME, question, question_stem, options, answer_index, evidence_spans. truth: id, SAME, answer, source_answer_index, option_permutation, options, question (the prompt), question_stem,
    video_path. inputs: SHOWN and no more. provenance: id, duration, observations (times). labels: id, answer_index, status, question_type. videos: episode_id, video_path. splits: split, id. mirrors: episode_id, id.

    The files are joined on the id once, so a rule that compares two of them reads columns of one row; a question that a file lacks breaks that file's rule alone.
    """
    found = []
    files = {"truth": truth, "inputs": inputs, "provenance": provenance, "labels": labels}
    for name, df in {"questions": questions, **files}.items():
        found.append(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(f"once in {name}").alias("rule")))
    whole = questions.dropDuplicates(["id"]).select("id", *[F.col(c).alias(f"q_{c}") for c in questions.columns if c != "id"])
    for name, df in files.items():
        own = df.dropDuplicates(["id"]).select("id", F.lit(True).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "id"])
        found.append(own.join(whole.select("id"), "id", "left_anti").select("id", F.lit(f"{name} without a question").alias("rule")))
        whole = whole.join(own, "id", "left")
    paths = videos.groupBy("episode_id").agg(F.count("*").alias("videos"), F.min("video_path").alias("v_path"))
    found.append(paths.where("videos > 1").select(F.col("episode_id").alias("id"), F.lit("one video an episode").alias("rule")))
    whole = whole.join(paths.withColumnRenamed("episode_id", "q_episode_id"), "q_episode_id", "left")
    answer, status = F.col("q_answer_index"), F.col("q_status")
    chosen = F.try_element_at("q_options", answer.cast("int") + 1)
    here = lambda name, rule: F.col(name).isNull() | F.coalesce(rule, F.lit(False))  # noqa: E731  a missing row has its own rule
    held = {
        **{f"in {name}": F.col(name).isNotNull() for name in files},
        "options": (F.size("q_options") == positions) & (F.size(F.array_distinct("q_options")) == positions),
        "answer index": answer.between(0, positions - 1),
        "abstention among the options": F.array_contains("q_options", abstention),
        "status": status.isin("known", "uncertain"),
        "abstention fits the status": (chosen == abstention) == (status == "uncertain"),
        "answers agree": here("truth", (answer == F.col("truth_answer")) & (answer == F.col("truth_source_answer_index"))) & here("labels", answer == F.col("labels_answer_index")),
        "options in their order": here("truth", F.col("truth_option_permutation") == F.array(*[F.lit(k) for k in range(positions)])),
        "options agree": here("truth", F.col("q_options") == F.col("truth_options")),
        **{f"{c} agrees": here("truth", F.col(f"q_{c}").eqNullSafe(F.col(f"truth_{c}"))) for c in SAME},
        "labels agree": here("labels", (F.col("labels_status") == status) & (F.col("labels_question_type") == F.col("q_question_type"))),
        "stem": here("truth", F.col("q_question_stem") == F.col("truth_question_stem")),
        "prompt": here("truth", F.col("truth_question") == prompt(F.col("q_question_stem"), F.col("q_options"))),
        "public fields": here("inputs", F.lit(set(inputs.columns) == set(SHOWN))) & F.when(F.col("truth").isNull() | F.col("inputs").isNull(), True).otherwise(F.coalesce(_equal([c for c in SHOWN if c != "id" and c in inputs.columns and c in truth.columns]), F.lit(False))),
        "time inside the video": here("provenance", (F.col("q_query_time") >= 0) & (F.col("q_query_time") < F.col("provenance_duration"))),
        "causal evidence": (F.size("q_evidence_spans") > 0) & F.forall("q_evidence_spans", lambda s: (s[0] >= 0) & (s[0] < s[1]) & (s[1] <= F.col("q_query_time"))),
        "causal, sampled observations": here("provenance", (F.size("provenance_observations") > 0) & F.forall("provenance_observations", lambda t: (t >= 0) & (t <= F.col("q_query_time")) & (t == F.floor(t)))),
        "portable video path": here("truth", ~F.startswith("truth_video_path", F.lit("/")) & ~F.array_contains(F.split("truth_video_path", "/"), "..")),
        "video of its episode": here("truth", F.col("truth_video_path") == F.col("v_path")),
    }
    found.append(rules.violations(whole, held))
    wanted = questions.select("id", F.when(F.col("status") == "known", "primary_visual_known").when(F.col("status") == "uncertain", "epistemic_uncertain").alias("split")).where("split is not null").distinct()
    named = splits.where(F.col("split").isin("primary_visual_known", "epistemic_uncertain")).select("id", "split").distinct()
    wrong = wanted.exceptAll(named).unionByName(named.exceptAll(wanted))
    found.append(wrong.select("id", F.lit("split").alias("rule")).distinct())
    sizes = questions.groupBy("episode_id").agg(F.count("*").alias("n"))
    found.append(sizes.where(F.col("n") != each).select(F.col("episode_id").alias("id"), F.lit("questions an episode").alias("rule")))
    found.append(videos.join(sizes, "episode_id", "left_anti").select(F.col("episode_id").alias("id"), F.lit("video without questions").alias("rule")))
    found.append(sizes.join(videos, "episode_id", "left_anti").select(F.col("episode_id").alias("id"), F.lit("video of an episode").alias("rule")))
    pairs, shown = questions.select("episode_id", "id"), mirrors.select("episode_id", "id")
    found.append(pairs.exceptAll(shown).unionByName(shown.exceptAll(pairs)).select("id", F.lit("mirror").alias("rule")).distinct())
    counts = questions.agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("answer_index") == p) for p in range(positions)]).alias("c"))
    found.append(counts.where("n > 0").where(F.array_max("c") - F.array_min("c") > 1).select(F.lit(None).cast(questions.schema["id"].dataType).alias("id"), F.lit("positions in balance").alias("rule")))
    found.append(counts.where("n = 0").select(F.lit(None).cast(questions.schema["id"].dataType).alias("id"), F.lit("rows").alias("rule")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _equal(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"inputs_{c}").eqNullSafe(F.col(f"truth_{c}"))
    return out


def segment_violations(segments: DataFrame, roles: list[str], activities: list[str]) -> DataFrame:
    """(id, rule) of segments (id, video, start, end, role, activity): allowed values, length, order without gap or overlap within the video."""
    w = W.partitionBy("video").orderBy("start", "end", "id")
    before = F.lag("end").over(w)
    rows = segments.withColumn("_b", before)
    held = {
        "video": F.col("video").isNotNull(), "role": F.col("role").isin(roles), "activity": F.col("activity").isin(activities), "length": (F.col("start") >= 0) & (F.col("end") > F.col("start")),
        "follows the one before": F.col("_b").isNull() | (F.col("start") == F.col("_b")),
    }
    return rules.violations(rows, held)
