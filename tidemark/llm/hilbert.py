"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata columns are quantised to a few bits each, a row's cell on the Hilbert curve is computed with
array functions, rows are sorted by (curve index, id) through a range partitioning, and the sorted order is cut
into runs. Neighbours on the curve are near in every dimension, so each shard covers a small box of the metadata
space and min/max statistics of its file prune on any of the dimensions.

Cells hold about equal numbers of rows: numbers are cut at approximate quantiles; a category starts at the cell that its place among the
FREQUENT commonest values, by cumulated rows, gives it, and rarer values share the cells after those by their crc32.

Defined results: a null category is a value like any other, a null number takes cell 0 of its dimension; an empty table gives no rows; rows that repeat
each get a slot of their own; a null or empty text counts 0 bytes (plus the 16 of overhead), and texts of any length count whole. Ties of the curve are
broken by id, then by crc32 of the text. Equal texts are not kept together: ids are a dimension, so copies with distant ids may lie in different
shards; the law is `rows`, under which counts alone are even. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents

BITS = 6
OVERHEAD = 16
FREQUENT = 48


def category_cell(df: DataFrame, name: str, bits: int = BITS) -> Column:
    """Cell of a category: where its rows start if values are laid out by frequency. Rarer values share what is left."""
    cells, column = 1 << bits, F.col(name).cast("string")
    top = df.groupBy(column.alias("v")).count().orderBy(F.desc("count"), "v").limit(FREQUENT).collect()
    total = df.count() if len(top) == FREQUENT else sum(r["count"] for r in top)
    cell, none, before = [], F.lit(0), 0
    for r in top:
        at = F.lit(before * cells // total)
        if r["v"] is None:
            none = at
        else:
            cell += [F.lit(r["v"]), at]
        before += r["count"]
    left = min(cells - 1, before * cells // max(1, total))
    rest = F.lit(left) + F.crc32(column.cast("binary")) % (cells - left)
    own = F.coalesce(F.element_at(F.create_map(*cell), column), rest) if cell else rest
    return F.when(column.isNull(), none).otherwise(own).cast("long")


def number_cells(df: DataFrame, names: list[str], bits: int = BITS) -> list[Column]:
    """Cells of numbers, between approximate quantiles: a binary search as one expression."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(n, shares, 10_000).alias(f"q{k}") for k, n in enumerate(names)]).first()

    def search(value: Column, edges: list, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(edges[middle]), search(value, edges, middle + 1, high)).otherwise(search(value, edges, low, middle))

    return [F.lit(0).cast("long") if found[k] is None else search(F.col(n), found[k], 0, len(shares)).cast("long") for k, n in enumerate(names)]


def with_hilbert(df: DataFrame, cells: list[Column], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """Adds the Hilbert index of the cells: rotations undone from the highest bit down, Gray code, bits interleaved."""
    n, top = len(cells), 1 << (bits - 1)

    def turn(state: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        first, own = F.get(state, F.lit(0)), F.get(state, i)
        flips = own.bitwiseAND(q) != 0
        t = first.bitwiseXOR(own).bitwiseAND(q - 1)
        new_first = F.when(flips, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(t))
        return F.transform(state, lambda v, j: F.when(j == 0, new_first).when((j == i) & ~flips, v.bitwiseXOR(t)).otherwise(v))

    steps = F.array(*[F.struct(F.lit(top >> k).cast("long").alias("q"), F.lit(i).alias("i")) for k in range(bits - 1) for i in range(n)])
    df = df.withColumn("_x", F.aggregate(steps, F.array(*cells), turn))
    gray: list[Column] = []
    for i in range(n):
        gray.append(F.col("_x")[i] if i == 0 else gray[-1].bitwiseXOR(F.col("_x")[i]))
    df = df.withColumn("_x", F.array(*gray))
    last, turned = F.col("_x")[n - 1], F.lit(0).cast("long")
    for k in range(bits - 1):
        turned = turned.bitwiseXOR(F.when(last.bitwiseAND(top >> k) != 0, F.lit((top >> k) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_t", turned)
    index = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(n):
            bit = F.shiftright(F.col("_x")[i].bitwiseXOR(F.col("_t")), b).bitwiseAND(F.lit(1).cast("long"))
            index = index + F.shiftleft(bit, b * n + n - 1 - i)
    return df.withColumn(name, index).drop("_x", "_t")


def cut_runs(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Sorts by `order` over the whole table and cuts runs whose row counts differ by one at most: adds shard and slot.

    One range shuffle; a row's rank is its place in its partition plus the rows of the partitions before, one number a partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "runs")
    placed = placed.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_p").count()
    before = sizes.select(
        "_p",
        F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("count").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"),
    )
    ranked = placed.join(F.broadcast(before), "_p").withColumn("_rank", F.col("_before") + F.col("_i"))
    shard = F.expr(f"(_rank * {shards}) div _n")
    out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - F.expr(f"(shard * _n + {shards - 1}) div {shards}"))
    return out.drop("_at", "_p", "_i", "_before", "_n", "_rank")


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents' ids, sizes and shards; dimensions: language, source, length and id."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    cells = [category_cell(rows, "lang"), category_cell(rows, "source"), *number_cells(rows, ["size", "doc_id"])]
    indexed = with_hilbert(rows, cells).select("doc_id", "size", "text_crc32", "hilbert")
    return cut_runs(indexed, ["hilbert", "doc_id", "text_crc32"], shards)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes whole documents, one folder a shard, ordered by slot."""
    keys = hilbert_shards(docs, shards).select(F.col("doc_id").alias("_d"), F.col("text_crc32").alias("_c"), "shard", "slot").dropDuplicates(["_d", "_c"])
    own = docs.join(keys, docs["doc_id"].eqNullSafe(keys["_d"]) & (F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")) == keys["_c"])).drop("_d", "_c")
    own.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
