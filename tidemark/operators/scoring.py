"""Scores of selective predictions: known accuracy, abstention recall, their harmonic mean, and intervals by clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.running import cumulated
from tidemark.sources.tables import checkpointed


def outcomes(items: DataFrame, preds: DataFrame) -> DataFrame:
    """One row for each prediction: known, abstained, invalid, correct and er. A null choice is wrong and doesn't abstain; a prediction for an unknown id is an error."""
    rows = preds.join(items.withColumn("_there", F.lit(True)), "id", "left")
    known_id = F.when(F.col("_there"), F.col("abstention_index")).otherwise(F.raise_error(F.concat(F.lit("prediction for an unknown id: "), F.col("id").cast("string"))))
    rows = rows.withColumn("abstention_index", known_id).drop("_there")
    choice = F.col("pred_index")
    rows = rows.withColumn("abstained", F.coalesce(choice == F.col("abstention_index"), F.lit(False)))
    rows = rows.withColumn("invalid", choice.isNull()).withColumn("correct", F.coalesce(choice == F.col("answer"), F.lit(False)))
    return rows.withColumn("er", F.when(F.col("abstained"), 0).when(F.col("correct"), 1).otherwise(-1))


def share(what: Column, among: Column | None = None) -> Column:
    """Mean of a condition among the rows of another; null without rows."""
    value = F.when(what, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.avg(value if among is None else F.when(among, value))


def harmonic(a: Column, b: Column) -> Column:
    """Null if either is; 0 if both are 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / (a + b))


def measures() -> list[Column]:
    known, abstained, correct = F.col("known"), F.col("abstained"), F.col("correct")
    ka, ar = share(correct, known), share(abstained, ~known)
    rounded = {
        "accuracy": share(correct), "ka": ka, "ar": ar, "far": share(abstained, known), "abstention_precision": share(~known, abstained), "coverage": share(~abstained),
        "risk": share(~correct, ~abstained), "er": F.avg(F.col("er").cast("double")), "h": harmonic(ka, ar), "invalid_rate": share(F.col("invalid")),
    }
    counts = [F.count("*").alias("n"), F.count_if(known).alias("n_known"), F.count_if(~known).alias("n_uncertain")]
    return counts + [F.round(v, 6).alias(k) for k, v in rounded.items()]


def summary(rows: DataFrame, *by: Column | str) -> DataFrame:
    """The measures of all rows, or of each group whose keys aren't null."""
    if not by:
        return rows.agg(*measures())
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    out = rows.groupBy(*keys).agg(*measures())
    return out.dropna(subset=out.columns[: len(keys)])


def pooled_and_macro(rows: DataFrame, subset: str) -> DataFrame:
    """Pooled (weighted by counts) and macro (mean over subsets) ka, ar and h."""
    each = rows.groupBy(subset).agg(F.count_if("known").alias("k"), F.count_if(~F.col("known")).alias("u"), share(F.col("correct"), F.col("known")).alias("ka"), share(F.col("abstained"), ~F.col("known")).alias("ar"))
    each = each.withColumn("h", harmonic(F.col("ka"), F.col("ar")))
    ka, ar = F.sum(F.col("ka") * F.col("k")) / F.sum("k"), F.sum(F.col("ar") * F.col("u")) / F.sum("u")
    return each.agg(F.count("*").alias("subsets"), F.round(ka, 6).alias("pooled_ka"), F.round(ar, 6).alias("pooled_ar"), F.round(harmonic(ka, ar), 6).alias("pooled_h"), F.round(F.avg("h"), 6).alias("macro_h"))


def choice_distribution(preds: DataFrame) -> DataFrame:
    return preds.groupBy(F.coalesce(F.col("pred_index").cast("string"), F.lit("INVALID")).alias("choice")).agg(F.count("*").alias("n"))


def bootstrap(rows: DataFrame, cluster: str, replicates: int, value: str = "h") -> DataFrame:
    """Order-statistic bounds of h when clusters are drawn with replacement; draws are md5(replicate:slot) modulo the number of clusters.

    Each cluster is four counts, so a draw costs a join with a row a cluster and never touches predictions again.
    """
    stats = rows.groupBy(cluster).agg(F.count_if("known").alias("k"), F.count_if(F.col("known") & F.col("correct")).alias("kc"), F.count_if(~F.col("known")).alias("u"), F.count_if(~F.col("known") & F.col("abstained")).alias("ua"))
    ranked = cumulated(stats, [F.col(cluster)], slot=F.lit(1)).withColumn("slot", F.col("slot") - 1)
    stats = checkpointed(ranked.crossJoin(F.broadcast(stats.agg(F.count("*").alias("n")))))  # one row a cluster
    plan = stats.select("n", F.col("slot").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "turn")), 1, 8), 16, 10).cast("long") % F.col("n")
    plan = plan.select("rep", drawn.alias("slot"))
    ka, ar = F.try_divide(F.sum("kc"), F.sum("k")), F.try_divide(F.sum("ua"), F.sum("u"))
    draws = plan.join(stats, "slot").groupBy("rep").agg(harmonic(ka, ar).alias("h")).where("h is not null")
    sorted_values = draws.agg(F.array_sort(F.collect_list("h")).alias("v"))  # one number a replicate
    at = lambda p: F.element_at("v", (F.floor(F.lit(p) * (F.size("v") - 1)) + 1).cast("int"))
    return sorted_values.select(F.round(at(0.025), 6).alias("low"), F.round(at(0.975), 6).alias("high"), F.size("v").cast("long").alias("replicates"))


def bootstrap_measures(rows: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """Bounds of er, h, ka, ar and accuracy by the draws of bootstrap(); no rows with fewer than two clusters, nor for a measure that no draw defines."""
    yes = lambda c: F.count_if(c)
    known = F.col("known")
    stats = rows.groupBy(cluster).agg(F.count("*").alias("m"), F.sum(F.col("er").cast("double")).alias("e"), yes(F.col("correct")).alias("c"), yes(known).alias("k"), yes(known & F.col("correct")).alias("kc"), yes(~known).alias("u"), yes(~known & F.col("abstained")).alias("ua"))
    ranked = cumulated(stats, [F.col(cluster)], slot=F.lit(1)).withColumn("slot", F.col("slot") - 1)
    stats = checkpointed(ranked.crossJoin(F.broadcast(stats.agg(F.count("*").alias("n")))).where("n > 1"))  # one row a cluster
    plan = stats.select("n", F.col("slot").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "turn")), 1, 8), 16, 10).cast("long") % F.col("n")
    ka, ar = F.try_divide(F.sum("kc"), F.sum("k")), F.try_divide(F.sum("ua"), F.sum("u"))
    measures = {"er": F.sum("e") / F.sum("m"), "h": harmonic(ka, ar), "ka": ka, "ar": ar, "accuracy": F.sum("c") / F.sum("m")}
    draws = plan.select("rep", drawn.alias("slot")).join(stats, "slot").groupBy("rep").agg(*[v.alias(k) for k, v in measures.items()])
    long = draws.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in measures]))).where("v is not null")
    values = long.groupBy("measure").agg(F.array_sort(F.collect_list("v")).alias("v"))  # one number a replicate
    at = lambda p: F.round(F.element_at("v", (F.floor(F.lit(p) * (F.size("v") - 1)) + 1).cast("int")), 6)
    return values.select("measure", at(0.025).alias("low"), at(0.975).alias("high"), F.size("v").cast("long").alias("replicates"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs on the same known items: abstention of the first by correctness of the second."""
    both = first.where("known").join(second.select("id", F.col("correct").alias("forced_correct")), "id")
    return both.groupBy("abstained", "forced_correct").agg(F.count("*").alias("n"))


def blind_threshold(scores: DataFrame) -> DataFrame:
    """Best h of an agent that abstains where score >= threshold, over all thresholds; abstaining on everything and on nothing included."""
    flat = scores.groupBy("score").agg(F.count_if("known").alias("k"), F.count_if(F.col("known") & F.col("correct")).alias("kc"), F.count_if(~F.col("known")).alias("u"))
    run = cumulated(flat, [F.desc("score")], passed=F.col("kc"), caught=F.col("u"))
    whole = flat.agg(F.sum("kc").alias("all_kc"), F.sum("k").alias("all_k"), F.sum("u").alias("all_u"))
    run = run.crossJoin(F.broadcast(whole)).select("score", (F.col("all_kc") - F.col("passed")).alias("right"), "caught", F.col("all_k").alias("k"), F.col("all_u").alias("u"))
    h = harmonic(F.col("right") / F.col("k"), F.col("caught") / F.col("u"))
    return run.select("score", F.round(h, 6).alias("h")).orderBy(F.desc("h"), F.desc("score")).limit(1)


def reweighted(audit: DataFrame, population: DataFrame, *strata: str) -> DataFrame:
    """Weighted agreement: each stratum of the sample stands for its share of the population."""
    n, m = population.groupBy(*strata).agg(F.count("*").alias("whole")), audit.groupBy(*strata).agg(F.count("*").alias("own"))
    weighted = audit.join(n.join(m, list(strata)).withColumn("w", F.col("whole") / F.col("own")), list(strata))
    return weighted.agg(F.round(F.sum(F.when(F.col("correct"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("agreement"), F.count("*").alias("n"))


def text_headline(scores: DataFrame) -> DataFrame:
    """A line with percentages, n/a where undefined."""
    pct = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c) * 100)).otherwise("n/a")
    return scores.select(F.concat(F.lit("H "), pct("h"), F.lit(" KA "), pct("ka"), F.lit(" AR "), pct("ar")).alias("headline"))


def macro_replicates(outs: DataFrame, subset: str, cluster: str, runs: list[str], replicates: int = 1000) -> DataFrame:
    """(rep, run, ka, ar, h): measures of each run, averaged over subsets, when each subset's clusters are drawn with replacement.

    outs has known and, for each run, correct_<run> and abstained_<run>; all runs get the same draws, so their differences are paired. A cluster is a row of counts; its slots are numbered in its
    subset, and a draw is the MD5 of replicate and turn modulo the subset's clusters. A replicate in which a subset has no known, or no uncertain, item is left out.
    """
    counts = [F.count_if("known").alias("k"), F.count_if(~F.col("known")).alias("u")]
    for r in runs:
        counts += [F.count_if(F.col("known") & F.col(f"correct_{r}")).alias(f"kc_{r}"), F.count_if(~F.col("known") & F.col(f"abstained_{r}")).alias(f"ua_{r}")]
    part = W.partitionBy(subset)
    stats = outs.groupBy(subset, cluster).agg(*counts).withColumn("slot", F.row_number().over(part.orderBy(cluster)) - 1).withColumn("n", F.count("*").over(part))
    stats = checkpointed(stats)  # one row a cluster
    plan = stats.select(subset, "n", F.col("slot").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    slot = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "turn")), 1, 8), 16, 10).cast("long") % F.col("n")
    names = ["k", "u", *[f"{c}_{r}" for r in runs for c in ("kc", "ua")]]
    sums = plan.select("rep", subset, slot.alias("slot")).join(stats.drop("n"), [subset, "slot"]).groupBy("rep", subset).agg(*[F.sum(c).alias(c) for c in names])
    one = lambda r: F.struct(F.lit(r).alias("run"), F.try_divide(f"kc_{r}", "k").alias("ka"), F.try_divide(f"ua_{r}", "u").alias("ar"))
    each = sums.select("rep", subset, F.inline(F.array(*[one(r) for r in runs]))).withColumn("h", harmonic(F.col("ka"), F.col("ar")))
    means = each.groupBy("rep", "run").agg(*[F.avg(c).alias(c) for c in ("ka", "ar", "h")], F.count("*").alias("_m"), F.count("h").alias("_d"))
    return means.where("_m = _d").drop("_m", "_d")


def macro_intervals(draws: DataFrame) -> DataFrame:
    """Per run and measure of macro_replicates(): mean, 2.5 and 97.5 percent bounds (interpolated) and how many replicates count."""
    long = draws.select("run", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("ka", "ar", "h")])))
    return long.groupBy("run", "measure").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))


def paired_differences(draws: DataFrame, base: str) -> DataFrame:
    """Per other run: mean difference of h to the base run, draw by draw, its bounds, and the share of draws in which it is above zero."""
    own = draws.where(F.col("run") == base).select("rep", F.col("h").alias("_b"))
    gap = draws.where(F.col("run") != base).join(own, "rep").withColumn("d", F.col("h") - F.col("_b"))
    return gap.groupBy("run").agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("above"))
