"""Appending results once: a table of parts, one a micro-batch, and a ledger of the parts that count.

A part is written over whatever an earlier try has left in its place, and counts from the moment the ledger names it, which is one small write. So a batch that
is run again writes nothing if it was entered, and replaces its own part if the run stopped before that; no id is there twice and none is lost. A run with
another signature (of model, data and settings) than the ledger's is an error, as its rows would not compare.

Defined results: rows whose id is there already are not written again; of rows of one batch that share an id the smallest by their other columns counts; rows without an id are an error;
an empty batch is entered with no rows; a folder without a ledger has no results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

ENTRY = "run string, batch long, signature string, rows long"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).json(f"{folder}/ledger")
    except AnalysisException:  # nothing was entered yet
        return spark.createDataFrame([], ENTRY)


def results(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of entered parts; None before the first."""
    own = [(r["run"], r["batch"]) for r in entries(spark, folder).where("rows > 0").collect()]  # one a batch
    if not own:
        return None
    return spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/run={r}/batch={b}" for r, b in sorted(own)]).drop("run", "batch")


def append_once(batch: DataFrame, number: int, folder: str, signature: str, run: str, key: str = "id") -> int:
    """Appends a micro-batch's new rows; gives how many there were. run names the stream (a checkpoint's life), number its batch."""
    spark = batch.sparkSession
    known = entries(spark, folder)
    other = known.where(F.col("signature") != signature).select("signature").first()
    if other is not None:
        raise ValueError(f"{folder} holds results of another configuration: {other[0]}")
    if not known.where((F.col("run") == run) & (F.col("batch") == number)).isEmpty():
        return 0
    checked = batch.withColumn(key, F.coalesce(key, F.raise_error(F.lit(f"a result has no {key}")).cast(batch.schema[key].dataType)))
    more = [c for c in batch.columns if c != key]
    new = checked.groupBy(key).agg(F.min(F.struct(*more)).alias("_m")).select(key, "_m.*").select(*batch.columns) if more else checked.distinct()
    held = results(spark, folder)
    if held is not None:
        new = new.join(held.select(key), key, "left_anti").select(*batch.columns)
    part = f"{folder}/rows/run={run}/batch={number}"
    new.write.mode("overwrite").parquet(part)
    rows = spark.read.schema(batch.schema).parquet(part).count()
    spark.createDataFrame([(run, number, signature, rows)], ENTRY).coalesce(1).write.mode("append").json(f"{folder}/ledger")
    return rows


def appending(folder: str, signature: str, run: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch."""

    def write(batch: DataFrame, number: int) -> None:
        append_once(batch, number, folder, signature, run, key)

    return write


def pending(items: DataFrame, folder: str, key: str = "id") -> DataFrame:
    """Items without a result yet."""
    held = results(items.sparkSession, folder)
    return items if held is None else items.join(held.select(key), key, "left_anti").select(*items.columns)


def progress(items: DataFrame, folder: str, group: str, key: str = "id") -> DataFrame:
    """Per group of items: how many there are, how many have results, and whether all have."""
    held = results(items.sparkSession, folder)
    done = items.select(group, F.lit(False).alias("done")) if held is None else items.join(held.select(key, F.lit(True).alias("done")), key, "left").select(group, F.coalesce("done", F.lit(False)).alias("done"))
    return done.groupBy(group).agg(F.count("*").alias("items"), F.count_if("done").alias("done")).withColumn("complete", F.col("items") == F.col("done"))


class Snapshots(StreamingQueryListener):
    """Keeps a snapshot for each batch of the streams that run: name, batch, rows read, rows of state. report(snapshot), if given, is called with each."""

    def __init__(self, report: Callable[[dict], None] | None = None):
        self.held: list[dict] = []
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.held.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})
        if self.report:
            self.report(self.held[-1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
