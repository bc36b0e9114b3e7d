"""Items: normal form, prompts, options rebuilt to three and an abstention, ids, and edits of wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as X

ABSTENTION = "The evidence seen so far is not enough to tell."

#: Wordings of options that state that evidence is insufficient.
META = r"cannot be (determined|established|resolved|confirmed|inferred|told|identified)|can't be determined|cannot (determine|tell|confirm)|not enough (visual )?evidence|enough (identity cues|discriminative evidence)|insufficient|uncertain|unreadable|undetermin|not determinable|do(es)? not (establish|reveal|uniquely|determine|allow|confirm|provide|preserve)|no definite|no unique|no concrete alternative|none of the concrete|remains? (ambiguous|unresolved|unknown|unclear)|ambiguous (in|across)|leaves? .*unresolved|absent from the visual record|not (be |visibly )?established|not visible enough|contents not visible|not observed( clearly enough)?|lacks enough|cannot be recovered|cannot rule out|not sufficiently observed|not shown in the available"

#: Prefixes of an episode's name, the folder its video lies in (or none), by precedence.
SITES = ["cmu", "sfu", "unc", "uniandes", "utokyo", "minnesota", "georgiatech", "nus"]


def is_meta(option: Column) -> Column:
    return option.rlike("(?i)" + META)


def normal_permutation(name: Column, count: Column, abstention: Column) -> Column:
    """Option numbers as shown: by hash, the abstention kept in its place."""
    free = X.option_permutation(name, F.when(abstention.isNull(), count).otherwise(count - 1))
    moved = F.transform(free, lambda k: F.when(k >= abstention, k + 1).otherwise(k))
    return F.when(abstention.isNull(), free).otherwise(F.concat(F.slice(moved, F.lit(1), abstention), F.array(abstention), F.slice(moved, abstention + 1, count)))


def normalised(items: DataFrame) -> DataFrame:
    """Items with shown options, the shown answer and the prompt. From 2 to 26 options; an answer outside them is an error."""
    n = F.size("options")
    good = n.between(2, 26) & F.col("answer_index").between(0, n - 1)
    rows = items.withColumn("option_permutation", F.when(good, normal_permutation(F.col("id"), n, F.col("abstention_index").cast("int"))).otherwise(F.raise_error(F.concat(F.lit("options or answer out of range: "), F.col("id")))))
    shown = F.transform("option_permutation", lambda k: F.get(F.col("options"), k))
    lines = F.array_join(F.transform(shown, lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), o)), "\n")
    return rows.select(
        *items.columns, "option_permutation", F.col("answer_index").alias("source_answer_index"), (F.array_position("option_permutation", F.col("answer_index").cast("int")) - 1).alias("answer"),
        F.concat(F.rtrim(F.coalesce(F.nullif(F.col("question_stem"), F.lit("")), "question")), F.lit("\n"), lines).alias("prompt"),
    )


def media_name(*columns: str) -> Column:
    """The first that is given and not empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def video_path(episode: Column, released: str = r"^[A-Za-z]+_([a-z]+)_\d+$") -> Column:
    """Where an episode's video lies: released names and site names at the top, others in a folder of participant or floor plan."""
    part = lambda p: F.nullif(F.regexp_extract(episode, p, 1), F.lit(""))
    top = F.coalesce(part(released))
    folder = F.coalesce(part(r"^(P\d+)"), part(r"(FloorPlan\d+)"))
    site = F.coalesce(part(r"^([a-z]+)_bike"), part(r"^(iiith|indiana)_"), part(f"^({'|'.join(SITES)})_"))
    name = F.concat(episode, F.lit(".mp4"))
    return F.when(top.isNotNull(), name).when(folder.isNotNull(), F.concat_ws("/", folder, name)).when(site.isNotNull(), name).otherwise(F.raise_error(F.concat(F.lit("no video folder for "), episode)))


def options_only(prompt: Column) -> Column:
    """The prompt's option lines."""
    return F.array_join(F.filter(F.split(prompt, "\n"), lambda x: x.rlike(r"^\([A-Z]\) ")), "\n")


def forced_choice(prompt: Column, abstention: str = ABSTENTION) -> Column:
    """The prompt without the abstention's line."""
    return F.array_join(F.filter(F.split(prompt, "\n"), lambda x: ~F.endswith(x, F.lit(abstention))), "\n")


def rebuilt(items: DataFrame) -> DataFrame:
    """Three substantive options and the abstention. Known items drop a distractor - a worded abstention, or the one that brings the answer nearest to
    its target length rank, ties by hash - and put the answer at its target place; targets go round within (status, type) by id."""
    k = F.row_number().over(W.partitionBy("status", "question_type").orderBy("id")) - 1
    rows = items.withColumn("_k", k).withColumn("_pos", F.col("_k") % 3).withColumn("_rank", F.floor(F.col("_k") / 3) % 3)
    numbers, gold = F.sequence(F.lit(0), F.size("options") - 1), F.col("answer_index")
    right = F.get(F.col("options"), gold)

    def cost(i: Column) -> Column:
        kept = F.filter(F.col("options"), lambda o, j: j != i)
        meta = F.when(is_meta(F.get(F.col("options"), i)), 0).otherwise(1)
        return F.struct(meta.alias("m"), F.when(meta == 0, 0).otherwise(F.abs(X.length_rank(right, kept) - F.col("_rank"))).alias("c"), F.sha2(F.concat(F.col("id"), F.lit(":"), i.cast("string")), 256).alias("h"), i.alias("i"))

    drop = F.array_min(F.transform(F.filter(numbers, lambda i: i != gold), cost))["i"]
    rows = rows.withColumn("_drop", F.when(F.col("status") == "uncertain", gold).otherwise(drop))
    left = F.filter(F.col("options"), lambda o, j: (j != F.col("_drop")) & (j != gold))
    known = F.concat(F.slice(left, F.lit(1), F.col("_pos").cast("int")), F.array(right), F.slice(left, F.col("_pos").cast("int") + 1, F.size(left)))
    three = F.when(F.col("status") == "uncertain", left).otherwise(known)
    return rows.withColumn("dropped_option", F.get(F.col("options"), F.col("_drop"))).withColumn("rebuilt", F.concat(three, F.array(F.lit(ABSTENTION)))).withColumn("answer_index", F.when(F.col("status") == "uncertain", 3).otherwise(F.col("_pos")).cast("long")).drop("_k", "_pos", "_rank", "_drop").withColumn("options", F.col("rebuilt")).drop("rebuilt")


def neutral_ids(items: DataFrame, telling: str) -> DataFrame:
    """Ids that tell the label get the next numbers of their episode, in order of time and id."""
    number = F.regexp_extract("id", r"_q(\d+)$", 1)
    rows = items.withColumn("_tells", F.col("id").rlike(telling)).withColumn("_n", F.when(~F.col("id").rlike(telling), F.nullif(number, F.lit("")).cast("long")))
    top = F.coalesce(F.max("_n").over(W.partitionBy("episode_id")), F.lit(0))
    place = F.row_number().over(W.partitionBy("episode_id", "_tells").orderBy("query_time", "id"))
    return rows.withColumn("new_id", F.when(F.col("_tells"), F.concat(F.col("episode_id"), F.lit("_q"), F.format_string("%02d", top + place))).otherwise(F.col("id"))).drop("_tells", "_n")


def relabelled_known(items: DataFrame, choice: Column) -> DataFrame:
    """A letter becomes the answer; sources of uncertainty are cleared."""
    return items.withColumn("answer_index", (F.ascii(choice) - 65).cast("long")).withColumn("status", F.lit("known")).withColumn("sources", F.array().cast("array<string>"))


def localised(events: DataFrame, start: Column, speed: Column) -> DataFrame:
    """Event times on a clip's clock: from its start, at its speed, two decimals, not below 0."""
    at = lambda c: F.greatest(F.round((F.col(c) - start) / speed, 2), F.lit(0.0))
    return events.withColumn("start", at("start")).withColumn("end", at("end"))


def templated(items: DataFrame, templates: DataFrame) -> DataFrame:
    """Wordings by turns: the item's ordinal modulo the number of its type's templates; `{x}` is replaced by the subject."""
    n = templates.groupBy("question_type").agg(F.count("*").alias("_n"))
    rows = items.join(n, "question_type").withColumn("slot", F.pmod(F.col("ordinal"), F.col("_n")))
    return rows.join(templates, ["question_type", "slot"]).withColumn("question", F.replace(F.col("template"), F.lit("{x}"), F.col("subject"))).drop("_n", "template")


def unindexed(prompt: Column) -> Column:
    """Whether the question itself doesn't speak of indexed things."""
    return ~X.question_stem(prompt).rlike(r"\bindexed\b")


def prefixes(items: DataFrame, fps: float) -> DataFrame:
    """The distinct causal prefixes the items need, in frames; none is an error."""
    n = F.floor(F.col("query_time") * fps + X.TICK).cast("long")
    return items.select("episode_id", F.when(n > 0, n).otherwise(F.raise_error(F.lit("a prefix has no frame"))).alias("frames")).distinct()
