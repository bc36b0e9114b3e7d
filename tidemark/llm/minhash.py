"""Near-duplicates by b-bit MinHash.

A text's set holds its distinct shingles of WORDS words. PERMUTATIONS minima are taken of each set; bands of ROWS minima
name its buckets, and the low BITS bits of all minima are packed, plane by plane, to a signature. Within a bucket,
similarity is estimated by bit counts: a share m of equal low bits means (m - 2^-b) / (1 - 2^-b). Pairs whose estimate
is SLACK below the threshold at least are confirmed on the full sets.

Equal texts are one node; nodes are numbered in the order of (smallest id, digest). Each bucket gives a spanning forest of the pairs whose
estimates reach that, and the forests' components are the families: every candidate pair lies within one. A family's texts travel to the
tasks that confirm it. There, a search goes from text to text; each is compared with those not reached so far that share a bucket with it
and whose estimate suffices, so a group of close copies takes one comparison a text, no pair is compared twice and none is left out.

Buckets of more than BLOCK signatures are dealt out in blocks, and every two blocks meet in a task of their own. Families of more than FAMILY
texts are dealt out in blocks too, each with the family's PIVOTS texts, so that copies find each other through them; what is not in the
family's largest group then meets the blocks of the family again, and only pairs of different groups are compared. So a large group of
close copies sends each text once or twice. Tasks report spanning forests, never all pairs.

Defined results: null, empty and blank texts have no shingles and stay alone; a text of fewer words is one shingle; of any length, the whole text counts;
rows that share an id are told apart by their texts; rows without an id are linked like others, and a group in which no row has an id has no
component_id; of equal (id, text) rows all are marked as kept or none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, cut, documents, drop_cut, id_out, partitions, release, texts
from .components import components

PERMUTATIONS = 128
BITS = 4
ROWS = 4
BANDS = 24
SLACK = 0.18
BLOCK = 2048
FAMILY = 512
PIVOTS = 8
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_words: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    if len(_words) > 100_000:
        _words.clear()
    found = text.encode().lower().split()
    for w in set(found):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit names of a text's shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def minima(names: np.ndarray) -> np.ndarray:
    """High halves of the smallest values of all permutations of a non-empty set."""
    best = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for low in range(0, len(names), 512):
        part = names[low : low + 512]
        best = np.minimum(best, (_A[:, None] * part[None] + _B[:, None]).min(1))
    return mixed(best)


def packed(values: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, one plane of 128 bits after the other."""
    planes = (values[None] >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes, axis=1).view(np.uint64).ravel()


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates of one signature against many."""
    x = (one[None] ^ many).reshape(len(many), BITS, -1)
    differ = np.bitwise_or.reduce(x, axis=1)
    equal = 1 - np.bitwise_count(differ).sum(1) / PERMUTATIONS
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row: _id, digest of the text, size of the set, band keys and signature (null where the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands, sigs = [], [], []
            for t in batch.column("text").to_pylist():
                names = shingles(t, words)
                sizes.append(len(names))
                if not len(names):
                    bands.append(None)
                    sigs.append(None)
                    continue
                values = minima(names)
                keys = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[k : BANDS * ROWS : ROWS])
                bands.append(keys.view(np.int64))
                sigs.append(packed(values).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["_id", "digest", "n_shingles", "bands", "sig"])
            release()

    rows = docs.select("_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    return cut(rows.mapInArrow(run, "_id long, digest binary, n_shingles long, bands array<long>, sig binary"), "signatures")


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, nodes, signatures) of each unit of a partition, nodes ascending."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    unit, nodes = (whole.column(c).to_numpy() for c in ("unit", "node"))
    order = np.lexsort((nodes, unit))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(unit[order]) != 0, [True]])).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        own = order[a:b]
        rows = whole.take(own)
        yield rows, nodes[own], np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(len(own), -1)


def search(n: int, joined: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest: joined(v, others) marks which of the rows not reached yet are linked to v."""
    a, b, left = [], [], np.arange(n)
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            v = reached.pop()
            near = joined(v, left)
            new = left[near].tolist()
            a += [v] * len(new)
            b += new
            reached += new
            left = left[~near]
    return a, b


def pair_batch(ids: np.ndarray, a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[np.array(a, np.int64)]), pa.array(ids[np.array(b, np.int64)])], names=["a", "b"])


def forests(least: float):
    """Spanning forests of the pairs of each unit whose estimates suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, sigs in unit_rows(batches):
            yield pair_batch(nodes, *search(len(nodes), lambda v, left, sigs=sigs: similarity(sigs[v], sigs[left]) >= least))

    return run


def overlaps(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share the percentage of their union."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or 100 * len(p) < percent * len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def asked(sets: list[np.ndarray], sigs: np.ndarray, bands: np.ndarray, side: np.ndarray, group: np.ndarray, percent: int, least: float) -> tuple[list[int], list[int]]:
    """Links of the rows of side 1 with rows of side 0, one for each other group, whose members are linked already."""
    a, b, others = [], [], np.flatnonzero(side == 0)
    for v in np.flatnonzero(side > 0).tolist():
        maybe = (bands[others] == bands[v]).any(1) & (similarity(sigs[v], sigs[others]) >= least) & (group[others] != group[v])
        done: set[int] = set()
        for k in others[maybe].tolist():
            if int(group[k]) not in done and overlaps(sets[v], sets[k], percent):
                done.add(int(group[k]))
                a.append(v)
                b.append(k)
    return a, b


def confirmed(words: int, percent: int, least: float):
    """Forests of the links of each unit, confirmed on full sets; where a unit has both sides, of the links between those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, nodes, sigs in unit_rows(batches):
            bands = np.array(rows.column("bands").to_pylist(), np.int64)
            side, group = rows.column("side").to_numpy(), rows.column("group").to_numpy()
            sets = [shingles(t, words) for t in rows.column("text").to_pylist()]

            def joined(v: int, left: np.ndarray, sigs=sigs, bands=bands, sets=sets) -> np.ndarray:
                maybe = (bands[left] == bands[v]).any(1) & (similarity(sigs[v], sigs[left]) >= least)
                for k in np.flatnonzero(maybe).tolist():
                    maybe[k] = overlaps(sets[v], sets[left[k]], percent)
                return maybe

            if (side > 0).all():
                yield pair_batch(nodes, *search(len(nodes), joined))
            else:
                yield pair_batch(nodes, *asked(sets, sigs, bands, side, group, percent, least))
        release()

    return run


def blocked(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows of groups (column n: their sizes) dealt to units of one block or of two."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.withColumn("unit", F.xxhash64(*keys, F.least("block", "_o"), F.greatest("block", "_o")))


def family_links(members: DataFrame, words: int, percent: int, least: float) -> DataFrame:
    """Forests of the links within families: members (family, n: its texts, node, sig, bands, text)."""
    parts = partitions(members.sparkSession)
    columns = ("unit", "node", "side", "group", "sig", "bands", "text")
    confirm = lambda units, label: cut(units.select(*columns).repartition(parts, "unit").mapInArrow(confirmed(words, percent, least), "a long, b long"), label)
    blocks = F.ceil(F.col("n") / FAMILY).cast("int")
    block, all_blocks = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    large = cut(members.where(f"n > {FAMILY}").select("family", "n", "node"), "large")
    none_large = large.isEmpty()
    own = members.withColumn("side", F.lit(1)).withColumn("group", F.col("node"))
    first = own.withColumn("at", block)
    if not none_large:
        picks = [F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node"))["node"].alias(f"p{k}") for k in range(PIVOTS)]
        pivots = large.groupBy("family").agg(*picks).select(F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("node"))
        guests = own.join(cut(pivots, "pivots"), "node").withColumn("home", block).withColumn("at", all_blocks).where("at <> home").drop("home")
        first = first.unionByName(guests)
    links = confirm(first.withColumn("unit", F.xxhash64("family", "at")), "links")
    if none_large:
        return links
    found = components(links).withColumnsRenamed({"component": "found"})
    groups = cut(large.join(found, "node", "left").select("family", "node", F.coalesce("found", "node").alias("group")), "groups")
    counts = groups.groupBy("family", "group").agg(F.count("*").alias("k"))
    main = cut(counts.groupBy("family").agg(F.max_by("group", F.struct("k", "group")).alias("main")), "main")
    left = cut(counts.join(main, "family").where("group <> main").groupBy("family", "main").agg(F.sum("k").alias("others")), "left")
    if left.isEmpty():
        return links
    rows = members.join(groups.join(left, "family").drop("family"), "node")
    other_blocks = F.ceil(F.col("others") / FAMILY).cast("int")
    inside = rows.withColumn("side", F.lit(0)).withColumn("x", block).withColumn("y", F.explode(F.sequence(F.lit(0), other_blocks - 1)))
    asking = rows.where("group <> main").withColumn("side", F.lit(1)).withColumn("y", F.pmod(F.xxhash64("node"), other_blocks).cast("int")).withColumn("x", all_blocks)
    second = inside.unionByName(asking).withColumn("unit", F.xxhash64("family", "x", "y"))
    return cut(links.unionByName(confirm(second, "more_links")), "all_links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: _id, digest of the text, n_shingles, component_id and whether the row is its group's first (by id, then by digest)."""
    docs, spark = texts(docs), docs.sparkSession
    least, n = percent / 100 - SLACK, partitions(spark)
    rows = signatures(docs, words)
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("_id").alias("_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    numbered = classes.repartitionByRange(n, "_id", "digest").sortWithinPartitions("_id", "digest")
    nodes = cut(numbered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", "sig", F.posexplode("bands").alias("band", "key"))
    shared = cut(banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    if shared.count() <= BROADCAST_IDS:  # 40 MB of buckets; then signatures are not shuffled to find theirs
        shared = F.broadcast(shared)
    cells = blocked(banded.join(shared, ["band", "key"]), ["band", "key"], BLOCK).select("unit", "node", "sig")
    close = cut(cells.repartition(n, "unit").mapInArrow(forests(least), "a long, b long").distinct(), "close")
    families = components(close).withColumnsRenamed({"component": "family"})
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    known = cut(nodes.join(families.join(sizes, "family"), "node"), "members")
    wanted = known.select("_id").distinct()
    if known.count() <= BROADCAST_IDS:  # 16 MB of ids; more are joined by a shuffle
        wanted = F.broadcast(wanted)
    held = docs.join(wanted, "_id", "left_semi").withColumn("digest", F.unhex(F.sha2("text", 256))).dropDuplicates(["_id", "digest"])
    members = cut(known.join(held, ["_id", "digest"]).select("family", "n", "node", "sig", "bands", "text"), "member_texts")
    found = components(family_links(members, words, percent, least))
    drop_cut(members)
    drop_cut(known)

    heads = nodes.select(F.col("node").alias("component"), F.col("_id").alias("head"), F.col("digest").alias("head_digest"))
    named = found.join(heads, "component").withColumnsRenamed({"node": "n"})
    reps = nodes.select("digest", "node", "_id").join(named, F.col("node") == F.col("n"), "left")
    reps = cut(reps.select("digest", F.coalesce("head", "_id").alias("head"), F.coalesce("head_digest", "digest").alias("head_digest")), "classes")
    out = rows.select("_id", "digest", "n_shingles").join(reps, "digest", "left")
    head = F.coalesce("head", "_id")
    kept = (F.col("_id") == head) & (F.col("digest") == F.coalesce("head_digest", "digest"))
    return out.select("_id", "digest", "n_shingles", F.when(head != NO_ID, head).alias("component_id"), kept.alias("first"))


def op7_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=2, percent=80)
    kept = F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("_id") == F.col("component_id"))
    return out.select(id_out(), "n_shingles", "component_id", kept.alias("kept"))
