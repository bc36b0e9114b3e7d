"""Questions from an event log: each generator is a projection of events with what was seen before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draft(rows: DataFrame, kind: str, question: Column, answer: Column, time: Column) -> DataFrame:
    """The columns every question has."""
    return rows.select("episode", F.lit(kind).alias("question_type"), time.cast("double").alias("query_time"), question.alias("question"), answer.cast("string").alias("answer"))


def factual(events: DataFrame) -> DataFrame:
    """What happened: each event's own kind."""
    return draft(events, "factual_retrieval", F.concat(F.lit("What happened at "), F.col("seq").cast("string"), F.lit("?")), F.col("event_type"), F.col("t"))


def predecessor(events: DataFrame) -> DataFrame:
    """What came just before: known from the second event on."""
    w = W.partitionBy("episode").orderBy("seq")
    rows = events.withColumn("_b", F.lag("event_type").over(w)).where("_b is not null")
    return draft(rows, "temporal_reasoning", F.concat(F.lit("What came just before the "), F.col("event_type"), F.lit(" at "), F.col("seq").cast("string"), F.lit("?")), F.col("_b"), F.col("t"))


def history_count(events: DataFrame, kind: str) -> DataFrame:
    """How many events of a kind there were so far, asked at each of them."""
    w = W.partitionBy("episode").orderBy("seq")
    rows = events.where(F.col("event_type") == kind).withColumn("_n", F.row_number().over(w))
    return draft(rows, "history_aggregation", F.lit(f"How many {kind} events so far?"), F.col("_n"), F.col("t"))


def current_state(events: DataFrame, asked: str, on: str, off: str) -> DataFrame:
    """Whether the thing is there when an `asked` event comes, by the last on or off event; uncertain before any."""
    w = W.partitionBy("episode").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = events.withColumn("_s", F.last(F.when(F.col("event_type").isin(on, off), F.col("event_type")), ignorenulls=True).over(w)).where(F.col("event_type") == asked)
    state = F.when(F.col("_s") == on, "visible").when(F.col("_s") == off, "hidden").otherwise("cannot tell")
    return draft(rows, "current_state", F.lit("Is it visible now?"), state, F.col("t"))


def state_change(events: DataFrame) -> DataFrame:
    """From what to what the kind of event changed."""
    w = W.partitionBy("episode").orderBy("seq")
    rows = events.withColumn("_b", F.lag("event_type").over(w)).where("_b <> event_type")
    return draft(rows, "state_change", F.lit("What changed?"), F.concat_ws(" to ", "_b", "event_type"), F.col("t"))


def tracking(events: DataFrame, off: str, on: str) -> DataFrame:
    """Where it returned: the first `on` event after each `off` event with nothing of either kind between."""
    w = W.partitionBy("episode").orderBy("seq")
    rows = events.where(F.col("event_type").isin(off, on)).withColumn("_n", F.lead("event_type").over(w)).withColumn("_t", F.lead("seq").over(w)).where((F.col("event_type") == off) & (F.col("_n") == on))
    return draft(rows, "object_tracking", F.lit("When did it return?"), F.col("_t"), F.col("t"))


def questions(events: DataFrame, on: str, off: str, asked: str) -> DataFrame:
    """All six kinds."""
    return reduce(DataFrame.unionByName, [factual(events), predecessor(events), history_count(events, off), current_state(events, asked, on, off), state_change(events), tracking(events, off, on)])
