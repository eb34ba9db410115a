"""Sharding by a hierarchical weighted hash tree.

A row's key descends from region to rack to shard. At each level every child
draws -ln(u) / weight, u being a hash of key and child; the least draw wins. A
child's draw depends on itself alone, so a changed weight moves rows only into
or out of the subtree that holds it. Capacity is added as a region, which
attracts rows into itself and moves none among the others.

Law ``key``: the key and the number of shards decide. Slots number each shard's
rows from 0 without gaps: rows are dealt into ``BUCKETS`` hash buckets within
their shard, counted, and numbered from their bucket's offset, so no task sorts
a whole shard.

Defined results: a null text has no bytes; a null key is a key like others;
equal texts are placed by their keys alone; rows that repeat a key share a shard
and take a slot each; an empty table gives an empty result; other columns are
ignored by ``place`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACKS, SHARDS_PER_RACK = 2, 4
BUCKETS = 256

#: region -> rack -> [(shard, weight)]
Tree = list[list[list[tuple[int, float]]]]


def topology(n_shards: int) -> Tree:
    """Equal shards in racks of four and regions of two racks; a remainder gets a last region of its own."""
    per = RACKS * SHARDS_PER_RACK
    regions = [list(range(i, min(i + per, n_shards))) for i in range(0, n_shards, per)]
    return [[[(s, 1.0) for s in ids[j : j + SHARDS_PER_RACK]] for j in range(0, len(ids), SHARDS_PER_RACK)] for ids in regions]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a new region."""
    last = max((s for region in tree for rack in region for s, _ in rack), default=-1)
    return [*tree, [[(last + 1, weight)]]]


def _draw(key: Column, level: int, node: Column, weight: Column) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(level), node), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of ``key``: three descents, each over the children of the node chosen before."""

    def choose(level: int, children: Column) -> Column:
        drawn = F.transform(children, lambda c: F.struct(_draw(key, level, c["id"], c["w"]).alias("d"), c["id"].alias("id")))
        return F.array_min(drawn)["id"]

    def table(rows: list[list[tuple[int, float]]]) -> Column:
        return F.array(*(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w")) for i, w in row)) for row in rows))

    rack_rows, shard_rows, region_row = [], [], []
    for r, region in enumerate(tree):
        racks = []
        for rack in region:
            racks.append((len(shard_rows), sum(w for _, w in rack)))
            shard_rows.append(rack)
        rack_rows.append(racks)
        region_row.append((r, sum(w for _, w in racks)))
    region = choose(0, table([region_row])[0])
    rack = choose(1, table(rack_rows)[region])
    return choose(2, table(shard_rows)[rack]).cast("int")


def place(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all rows."""
    tree = topology(n_shards)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body).alias("text_crc32"))
    key = F.col("doc_id")
    placed = sized.select(
        "doc_id", "size", "text_crc32", shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most n_shards * BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("n", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id") -> None:
    """Write all columns under ``path``/shard=N, each shard spread over files by row, not gathered in a task."""
    docs.withColumn("shard", shard_of(F.col(id_col), topology(n_shards))).write.partitionBy("shard").parquet(path)
