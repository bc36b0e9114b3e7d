"""Merging the shards of a run: pred_<shards>_<number>.jsonl files of one folder become one table, with a summary.

Defined results: absent shards are skipped and named in the summary; a folder without any shard, an id in two rows, a null id, and rows of two signatures are errors; files of another number
of shards are not read; rows come in the order of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scoring, sets


def read_shards(spark: SparkSession, folder: str, shards: int, schema: str) -> DataFrame:
    """Rows of a run's shards with `shard`. Columns beyond the schema are left out."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/pred_{shards}_*.jsonl")
    number = F.regexp_extract(F.input_file_name(), rf"pred_{shards}_(\d+)\.jsonl$", 1)
    return rows.withColumn("shard", F.when(number != "", number.cast("int"))).where(F.col("shard") < shards)


def merged(rows: DataFrame, signature: str | None = None) -> DataFrame:
    """Checked rows of read_shards(), in the order of the id: whole, unique and of one signature (a column, if there is one)."""
    checked = sets.unique_or_error(rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a prediction has no id")).cast(rows.schema["id"].dataType))), "id")
    if signature:
        kinds = rows.select(signature).distinct().limit(2).collect()
        if len(kinds) > 1:
            raise ValueError(f"predictions of two configurations: {kinds[0][0]} and {kinds[1][0]}")
    return checked.orderBy("id")


def summary(rows: DataFrame, shards: int, items: DataFrame | None = None, seen: Column | None = None) -> DataFrame:
    """One row: count, missing shards, the most frames seen; with items (id, known, answer, abstention_index) their selective measures too."""
    frames = F.max(F.lit(None).cast("long") if seen is None else seen.cast("long")).alias("most_frames_seen")
    missing = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.collect_set("shard"))
    counts = rows.agg(F.count("*").alias("count"), F.array_sort(missing).alias("missing_shards"), frames)
    if items is None:
        return counts
    return counts.crossJoin(scoring.summary(scoring.outcomes(items, rows.select("id", "pred_index"))))  # one row each


def merge_shards(spark: SparkSession, folder: str, shards: int, schema: str, target: str, items: DataFrame | None = None, signature: str | None = None, seen: str | None = None) -> DataFrame:
    """Writes the merged rows as JSON lines to `target` and gives their summary."""
    rows = read_shards(spark, folder, shards, schema)
    merged(rows, signature).drop("shard").write.mode("overwrite").json(target)
    return summary(rows, shards, items, None if seen is None else F.col(seen))
