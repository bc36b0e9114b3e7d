"""Runs whose episodes are bundles of JSON files, a folder each: all files of all bundles are read in one scan and meet by folder.

Defined results: a folder's name is its path below the run; other files are ignored. A bundle's first fault, in this order: a file is missing, is no JSON object, its
validation or trace is not accepted, frames failed, the plan's id is not the manifest's. Manifest rows without a directory are ignored, repeated ones count once;
folders outside the manifest are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEME = "^[^:/]+:/*"
#: The files of a bundle.
FILES = {"validation": "episode_validation.json", "trace": "execution_trace.json", "plan": "episode_plan.json", "profile": "scene_profile.json"}


def bundles(spark: SparkSession, run_dir: str, files: dict[str, str] | None = None) -> DataFrame:
    """(directory, and the text of each file, null where it is missing): a row a folder."""
    files = files or FILES
    glob = "{" + ",".join(files.values()) + "}"
    found = spark.read.text(run_dir, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    # schemes are written with one slash or three
    path = F.split(F.regexp_replace(F.expr("_metadata.file_path"), SCHEME, ""), "/")
    steps = len(re.sub(SCHEME, "", qualified(spark, run_dir)).split("/"))
    below = F.concat_ws("/", F.slice(path, steps + 1, F.size(path) - steps - 1))
    named = found.select(below.alias("directory"), F.element_at(path, -1).alias("file"), F.col("value"))
    return named.groupBy("directory").agg(*[F.max(F.when(F.col("file") == name, F.col("value"))).alias(part) for part, name in files.items()])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and host, as Spark reports those of files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def bundle_faults(spark: SparkSession, run_dir: str, manifest: DataFrame) -> DataFrame:
    """Each manifest row (directory, plan_id) with its bundle's files and `fault`, null for an accepted one."""
    wanted = manifest.where("directory is not null").groupBy("directory").agg(F.max("plan_id").alias("plan_id"))
    both = wanted.join(bundles(spark, run_dir), "directory", "left")
    fault = F.lit(None).cast("string")
    true = lambda part: F.coalesce(F.get_json_object(part, "$.accepted") == "true", F.lit(False))
    failed = F.coalesce(F.get_json_object("trace", "$.failed_frames"), F.lit("0"))
    same = F.get_json_object("plan", "$.plan_id").eqNullSafe(F.col("plan_id").cast("string"))
    rules = [(F.col(part).isNull(), f"{name} is missing") for part, name in FILES.items()]
    rules += [(F.from_json(part, "map<string,string>").isNull(), f"{name} is no JSON object") for part, name in FILES.items()]
    rules += [(~true("validation") | ~true("trace"), "not accepted"), (~failed.isin("0", "[]", "{}", "false", "", '""', "null"), "failed frames"), (~same, "plan id differs from the manifest")]
    for broken, says in reversed(rules):
        fault = F.when(broken, F.lit(says)).otherwise(fault)
    return both.withColumn("fault", fault)


def accepted_bundles(spark: SparkSession, run_dir: str, manifest: DataFrame) -> DataFrame:
    """(directory, plan_id, plan, trace, profile) of the manifest's bundles; one with a fault is an error that names it."""
    rows = bundle_faults(spark, run_dir, manifest)
    checked = F.when(F.col("fault").isNull(), F.col("directory")).otherwise(F.raise_error(F.concat_ws(": ", "directory", "fault")))
    return rows.select(checked.alias("directory"), "plan_id", "plan", "trace", "profile")
