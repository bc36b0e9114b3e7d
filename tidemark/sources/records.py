"""Files of JSON records: scans that check what they read, and sinks that replace nothing they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sets

ITEM = (
    "id string, episode_id string, query_time double, question_type string, question_subtype string, question string, question_stem string, "
    "options array<string>, answer_index bigint, abstention_index bigint, evidence_spans array<array<double>>, "
    "diagnostics struct<epistemic_status: string, uncertainty_sources: array<string>>, change_intensity bigint, video_evidence string"
)


def read_records(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """A JSON array or a file of JSON lines, told by its first character; blank lines are passed over, other than objects is an error."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).first()
    if first is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", first[0].lstrip().startswith("[")).option("mode", "FAILFAST").json(path)


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Lines by key, the last of each."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.monotonically_increasing_id())
    return sets.last_wins(rows, [key], "_at").drop("_at")


def read_predictions(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Shards of predictions; an id in two of them is an error."""
    return sets.unique_or_error(spark.read.schema(schema).json(paths), "id")


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result documents of many runs, with subset, protocol and model taken from the path (.../subset/models/protocol/model/result.json)."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_p", F.split(F.input_file_name(), "/"))
    at = lambda k: F.element_at("_p", k)
    return rows.withColumn("subset", at(-5)).withColumn("protocol", at(-3)).withColumn("model", at(-2)).drop("_p")


def read_edits(spark: SparkSession, pattern: str) -> DataFrame:
    """Lists of text edits in order of file name and place."""
    rows = spark.read.schema("id string, field string, old string, new string, reason string").option("multiLine", True).json(pattern)
    return rows.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("seq", F.monotonically_increasing_id())


def read_documents(spark: SparkSession, pattern: str, question: str) -> DataFrame:
    """One row for each question of documents of an episode each."""
    rows = spark.read.schema(f"episode_id string, questions array<struct<{question}>>").option("multiLine", True).json(pattern)
    return rows.select("episode_id", F.inline("questions"))


def find_media(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("mp4", "mkv", "mov", "webm")) -> DataFrame:
    """Paths of media files below a folder."""
    names = "{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{names}").load(folder).select("path", "length").orderBy("path")


def read_poses(spark: SparkSession, path: str, column: str) -> DataFrame:
    """White-space separated poses: a header of names, then numbers; three from the named column on. Values that aren't finite are an error."""
    header = [x for x in spark.read.text(path).limit(1).first()[0].split() if x]
    at = header.index(column) + 1
    parts = F.split(F.trim("value"), r"\s+")
    value = lambda k: F.element_at(parts, at + k).cast("double")
    good = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(F.raise_error(F.lit("pose is not finite")))
    return spark.read.text(path).where(F.col("value") != " ".join(header)).where("trim(value) <> ''").select(*[good(value(k)).alias(n) for k, n in enumerate("xyz")])


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Four-field lines: name, first frame, last frame, result; lines whose frames aren't numbers are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) == 4).select(parts[0].alias("action"), F.expr("try_cast(split(trim(value), '\\\\s+')[1] as bigint)").alias("first"), F.expr("try_cast(split(trim(value), '\\\\s+')[2] as bigint)").alias("last"), parts[3].alias("result"))
    return rows.where("first is not null and last is not null")


def frame_grid(videos: DataFrame, fps: float) -> DataFrame:
    """Frames at a fixed rate: rint(k * source rate / rate), within the video, each once."""
    last = F.ceil(F.col("frames") * fps / F.col("source_fps")).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda k: F.least(F.rint(k * F.col("source_fps") / fps), F.col("frames") - 1).cast("long"))
    return videos.withColumn("frame", F.explode(F.array_distinct(steps)))


def frame_linspace(videos: DataFrame, count: Column) -> DataFrame:
    """`count` frames spread from the first to the last, rounded half to even."""
    at = lambda k: F.bround(k * (F.col("frames") - 1) / F.greatest(count - 1, F.lit(1))).cast("long")
    return videos.withColumn("frame", F.explode(F.transform(F.sequence(F.lit(0), count - 1), at)))


def finite(rows: DataFrame) -> DataFrame:
    """The rows; a number that JSON can't hold is an error when they are read."""
    for name, kind in rows.dtypes:
        if kind == "double":
            c = F.col(name)
            rows = rows.withColumn(name, F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{name} is not finite"))).otherwise(c))
    return rows


def write_lines(rows: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines. The writer's commit protocol makes the write whole or absent."""
    (rows if files is None else rows.coalesce(files)).write.option("ignoreNullFields", False).json(path)


def write_public_private(rows: DataFrame, path: str, public: list[str], key: str = "id") -> None:
    """Allowed fields to one folder, the rest - with the key - to another."""
    write_lines(rows.select(*public), f"{path}/questions")
    write_lines(rows.select(key, *[c for c in rows.columns if c not in public]), f"{path}/labels")


def write_snapshot(rows: DataFrame, path: str, key: str) -> str:
    """To a folder named by the digest of all rows; an equal snapshot isn't written twice."""
    from tidemark.operators.distribution import fingerprint

    digest = fingerprint(rows, key).first()["digest"]
    rows.write.mode("ignore").parquet(f"{path}/{digest}")
    return digest


def rewrite_with_backup(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], stamp: str) -> str:
    """Rewrites a folder of JSON lines. What was there is kept as `<path>_backup_<stamp>`; it stays in place until the new rows are written whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, new, kept = hadoop(path), hadoop(f"{path}_next_{stamp}"), hadoop(f"{path}_backup_{stamp}")
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(kept):
        raise FileExistsError(f"{path}_backup_{stamp}")
    write_lines(change(spark.read.json(path)), str(new))
    if not files.rename(old, kept) or not files.rename(new, old):
        raise OSError(f"{path} could not be moved")
    return str(kept)
