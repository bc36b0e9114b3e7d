"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: null ids sort last and count as one document.
NO_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session with a local master gets a local one of our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Deletes a table that cut() wrote and that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


def release() -> None:
    """Gives back what a Python worker has freed: workers live on through many stages, and their allocators keep it otherwise."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep_heap() -> None:
    """Has this worker take its arrays of up to 32 MB from memory that it already holds: fresh pages for each array cost more than the sums in it. release() gives it back."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def one_thread() -> None:
    """Has matrix products of this worker use one thread: tasks share an executor's cores, and idle threads of the library would spin on them."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
        for path in paths:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break
    except OSError:  # no such library, or another system
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_col(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias("_id")


def id_out(name: str = "doc_id") -> Column:
    return F.when(F.col("_id") != NO_ID, F.col("_id")).alias(name)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(_id, text) of documents and the columns asked for, whatever other columns there are; a null text is empty."""
    return docs.select(id_col(), F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def documents(spark: SparkSession, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id gives modulo of crc32('')."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus
