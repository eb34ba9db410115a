"""SimHash near-duplicate groups with pigeonring filtering.

A text's fingerprint sums the hash bits of its word shingles. Its bits are cut
into m segments in a ring. If two fingerprints differ in at most t bits, then
from some start every chain of l consecutive segments differs in at most
floor(l * t / m) bits (the strong pigeonhole principle on a ring). Candidates
must agree with such a chain before the full Hamming check is made.

Exact mode (``links``): m = t + 1, so the first segment of the chain is equal
and the first two differ in at most one bit. The join key is the start with
both segments; one side of the join enumerates the one-bit variants of the
second. No link is lost and no bucket's rows are paired by brute force.

Wide mode (``drop_near_duplicates``): for a Jaccard similarity of shingle sets.
There the budget is a large share of the bits and no segment need be equal.
Fingerprints of 256 bits are laid on several rings (fixed permutations of the
bits); a candidate must share a whole segment, keep within the budgets along the
chain that starts there, and pass the full check. A small bucket's members are
compared pair by pair, a larger one's with a few leaders of their block, and each
member's nearest candidate is verified by the sets. This joins most of what
belongs together, but the filter is probabilistic and takes one candidate only,
so an exact way follows: two sets that are similar enough share one of their
rarest shingles (prefix filter). All pairs of different components in the buckets
of such shingles are compared, first by sizes and parities of the sets, which
lose none, then by the sets. They are compared within tasks, which return no more
links than it takes to join the components, so rows don't grow with pairs.

Equal fingerprints (wide mode: equal shingle sets) are collapsed first, so
copies never meet in a join. Only aggregates, equi-joins and components follow.

Defined results: a null or blank text has fingerprint zero, and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows share
a component; null doc_ids are ignored in choosing a component's smallest id
(null if there is no other); an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb, prod

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.session import small_batches, staged

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 8192

#: Differing bits of 256 that a candidate may have. At a Jaccard similarity of 0.8 each bit differs with
#: probability ``WIDE_CHANCE`` (arccos(2 * 0.8 / 1.8) / pi), so 39 on average; 56 are three deviations more.
WIDE_BITS, WIDE_CHANCE = 56, 0.1515
#: Share of such pairs that the rings must bring into a common bucket.
WIDE_RECALL = 0.95


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def _hashed(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, in blocks; a text of fewer words is one shingle, none has none."""
    if not words:
        return
    for start in range(0, max(1, len(words) - shingle + 1), _BLOCK):
        part = words[start : start + _BLOCK + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        digest, join = xxhash.xxh64_intdigest, b" ".join
        yield np.fromiter((digest(join(x), 42) for x in rows), dtype=np.uint64)


def _majority(blocks: Iterable[np.ndarray], words64: int) -> list[int]:
    """Signed 64-bit words, of which a bit is set if over half the hashes set it; without hashes zero."""
    counts, n = np.zeros((words64, 64), dtype=np.int64), 0
    for hashes in blocks:
        n += len(hashes)
        for k in range(words64):
            if k:  # further words: a fixed mix of the first
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                hashes ^= hashes >> np.uint64(29)
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
            counts[k] += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits((2 * counts > n).astype(np.uint8), axis=1).view(">u8").ravel()
    return [int(x) for x in packed.astype(np.uint64).view(np.int64)]


def fingerprint(text: str | None, shingle: int, words64: int = 1) -> list[int]:
    """Fingerprint of one text, repeated shingles counted each time."""
    return _majority(_hashed(_words(text), shingle), words64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *_hashed(_words(text), shingle)]))


def sketch(text: str | None, shingle: int, words64: int = 4) -> tuple[bytes, list[int]]:
    """A digest of the set of shingles, and the fingerprint of that set."""
    hashes = shingle_hashes(text, shingle)
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), _majority((hashes[i : i + _BLOCK] for i in range(0, len(hashes), _BLOCK)), words64)


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, words64: int = 1, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint column ``name``: a long, or an array of longs for more than 64 bits."""
    small_batches(docs.sparkSession)
    if words64 == 1:
        one = F.pandas_udf(lambda s: pd.Series([fingerprint(x, shingle)[0] for x in s], dtype="int64"), "long")
    else:
        one = F.pandas_udf(lambda s: pd.Series([fingerprint(x, shingle, words64) for x in s]), "array<long>")
    return docs.withColumn(name, one(F.col(text)))


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments of 64 bits, widths differing by one at most."""
    return [(64 * i // m, 64 * (i + 1) // m - 64 * i // m) for i in range(m)]


def _cut(fp: Column, seg: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, seg[0]).bitwiseAND(F.lit((1 << seg[1]) - 1))


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(u, v), u < v: every two distinct fingerprints of ``fps.fp`` within ``max_bits`` differing bits."""
    if max_bits < 1:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    m = max_bits + 1
    segs = _segments(m)
    budgets = [length * max_bits // m for length in range(1, m + 1)]
    fp = F.col("fp")

    def key(i: int, flip: int | None) -> Column:
        second = _cut(fp, segs[(i + 1) % m])
        second = second if flip is None else second.bitwiseXOR(F.lit(1 << flip))
        return F.struct(F.lit(i).alias("i"), _cut(fp, segs[i]).alias("a"), second.alias("b"))

    # a fixed spread before rows multiply, by another key than they are grouped by, which would be optimised away
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    stored = fps.select(fp.alias("v"), F.inline(F.array(*(key(i, None) for i in range(m)))))
    near = [key(i, flip) for i in range(m) for flip in (None, *range(segs[(i + 1) % m][1]))]
    probes = fps.select(fp.alias("u"), F.inline(F.array(*near)))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    within = F.bit_count(apart) <= max_bits
    for i in range(m):  # the chain from start i keeps within its budgets
        total, chain = F.lit(0), F.lit(True)
        for length in range(1, m):
            total = total + F.bit_count(_cut(apart, segs[(i + length - 1) % m]))
            chain = chain & (total <= budgets[length - 1])
        within = within & ((F.col("i") != i) | chain)
    return probes.join(stored, ["i", "a", "b"]).where("u < v").where(within).select("u", "v")


def rings(total_bits: int, n_rings: int, m: int) -> list[list[list[int]]]:
    """Per ring, m segments of bit numbers: permutations by fixed odd strides."""
    out = []
    for r in range(n_rings):
        rng = np.random.default_rng(7919 * (r + 1))
        order = [int(x) for x in rng.permutation(total_bits)]
        out.append([order[total_bits * i // m : total_bits * (i + 1) // m] for i in range(m)])
    return out


@lru_cache(maxsize=1)
def ring_counts() -> dict[int, int]:
    """Rings by segments per ring, as many as bring ``WIDE_RECALL`` of the pairs at a similarity of 0.8 into a common bucket.

    Each of such a pair's 256 bits differs with ``WIDE_CHANCE``; it shares a bucket if a segment, of the ring's
    real width, has no differing bit.
    """
    share = {d: comb(256, d) * WIDE_CHANCE**d * (1 - WIDE_CHANCE) ** (256 - d) for d in range(WIDE_BITS + 1)}

    def found(m: int, n_rings: int) -> float:
        widths = [256 * (i + 1) // m - 256 * i // m for i in range(m)]
        unequal = {d: prod(1 - comb(256 - w, d) / comb(256, d) for w in widths) for d in share}
        return sum(share[d] * (1 - unequal[d] ** n_rings) for d in share)

    return {m: next(n for n in range(4, 10_000) if found(m, n) >= WIDE_RECALL) for m in range(13, 6, -1)}


def ring_plan(rows: int) -> tuple[int, int]:
    """(segments per ring, rings) for so many fingerprints of 256 bits, of the layouts that find as many pairs.

    The one with the least work is taken: its keys, those that share a bucket with an unrelated fingerprint
    (four times as wide, with the words), and the comparisons there.
    """

    def work(m: int) -> float:
        others = rows / 2 ** (256 / m)
        return m * ring_counts()[m] * (1 + 4 * (1 - np.exp(-others)) + others)

    m = min(ring_counts(), key=work)
    return m, ring_counts()[m]


def _ring_starts(layout: list[list[list[int]]]) -> np.ndarray:
    """Masks of the chains: [start, length - 1, word], starts numbered over all rings."""
    m, total_bits = len(layout[0]), sum(map(len, layout[0]))
    masks = np.zeros((len(layout) * m, m, total_bits // 64), dtype=np.uint64)
    for r, ring in enumerate(layout):
        for i in range(m):
            for length in range(m):
                masks[r * m + i, length] = masks[r * m + i, length - 1] if length else 0
                for bit in ring[(i + length) % m]:
                    masks[r * m + i, length, bit // 64] |= np.uint64(1 << 63 - bit % 64)
    return masks


def _chain_check(layout: list[list[list[int]]], max_bits: int):  # noqa: ANN202
    """A function of differing bits (rows of 64-bit words) and starts: the rows whose every chain keeps within its budget.

    Chains are grown by one segment at a time and drop rows as they go; the last is the whole ring, that is the
    full Hamming check.
    """
    masks = _ring_starts(layout)
    limit = np.arange(1, masks.shape[1] + 1) * max_bits / masks.shape[1]

    def check(apart: np.ndarray, starts: np.ndarray) -> np.ndarray:
        left = np.arange(len(apart))
        for length in range(1, masks.shape[1]):
            left = left[np.bitwise_count(apart[left] & masks[starts[left], length]).sum(axis=1, dtype=np.int64) <= limit[length]]
        return left

    return check


#: Buckets of up to so many members are compared pair by pair; larger ones with ``LEADERS`` of each block.
SMALL_BUCKET, LEADERS = 64, 8
#: Members that a block of a larger bucket holds on average: what a task keeps in memory.
BLOCK = 4096


def _spans(*columns: np.ndarray) -> np.ndarray:
    """Row numbers at which a run of equal values in all ``columns`` starts, and the end."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def block_links(keys: np.ndarray, blocks: np.ndarray, words: np.ndarray, check) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """(i, j, differing bits) of row numbers in one block (rows come in order of key and block).

    In a small bucket all pairs that pass ``check``; in a larger one each member's nearest of the block's leaders,
    its first rows, and all pairs of leaders.
    """
    spans = _spans(keys, blocks)
    sizes = np.diff(spans)
    end = np.repeat(spans[1:], sizes)
    reach = np.where(np.repeat(sizes, sizes) <= SMALL_BUCKET, end, np.minimum(end, np.repeat(spans[:-1], sizes) + LEADERS))
    found = []

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = words[i] ^ words[j]
        near = check(apart, keys[i] >> 48)
        return i[near], j[near], np.bitwise_count(apart[near]).sum(axis=1, dtype=np.int64)

    i, step = np.arange(len(keys)), 1
    while len(i := i[i + step < reach[i]]):
        found.append(passing(i, i + step))
        step += 1
    for start, size in zip(spans[:-1][sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        members = np.arange(start + LEADERS, start + size)
        i, j, bits = passing(np.repeat(np.arange(start, start + LEADERS), len(members)), np.tile(members, LEADERS))
        order = np.lexsort((bits, j))
        first = order[np.append(True, j[order][1:] != j[order][:-1])] if len(order) else order
        found.append((i[first], j[first], bits[first]))
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (zip(*found, strict=True) if found else [[], [], []]))


def shared_keys(fps: DataFrame, layout: list[list[list[int]]]) -> DataFrame:
    """key, id, n: the segments that n > 1 rows of ``fps(id, words)`` share; a key names ring, start and bits."""
    m, n = len(layout[0]), sum(map(len, layout[0])) // 64

    @F.pandas_udf("array<long>")
    def keys(words: pd.Series) -> pd.Series:
        if not len(words):
            return pd.Series([], dtype=object)
        mat = np.stack(words.to_numpy()).astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8 * n)
        bits = np.unpackbits(mat, axis=1)
        out = np.empty((len(words), len(layout) * m), dtype=np.int64)
        for r, ring in enumerate(layout):
            for i, seg in enumerate(ring):
                out[:, r * m + i] = bits[:, seg].astype(np.int64) @ (np.int64(1) << np.arange(len(seg), dtype=np.int64)) + (np.int64(r * m + i) << 48)
        return pd.Series(list(out))

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed spread before rows multiply
    keyed = fps.repartition(parts, F.xxhash64("id")).select("id", F.explode(keys("words")).alias("key")).repartition(parts, "key")
    return staged(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "keys")


def _in_blocks(rows: DataFrame, run, schema: str, *by: str) -> DataFrame:  # noqa: ANN001
    """``run`` on whole groups of ``by``, longs only, in order of ``by`` and then of the other columns; many small groups at once."""

    def walk(batches):  # noqa: ANN001, ANN202
        open_: list[np.ndarray] = []  # rows of the group that may go on in the next batch
        for batch in batches:
            mat = np.ascontiguousarray(batch.to_numpy(dtype=np.int64))
            if not len(mat):
                continue
            cut = int(_spans(*mat[:, : len(by)].T)[-2])
            if open_ and (cut or (open_[0][0, : len(by)] != mat[-1, : len(by)]).any()):
                yield run(np.concatenate([*open_, mat[:cut]]))
                open_ = []
            elif cut:
                yield run(mat[:cut])
            open_.append(mat[cut:])
        if open_:
            yield run(np.concatenate(open_))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, "order").mapInPandas(walk, schema)


def _words_of(fps: DataFrame, n: int) -> list[Column]:
    return [F.col("words")[k].alias(f"w{k}") for k in range(n)]


def near_links(fps: DataFrame, shared: DataFrame, layout: list[list[list[int]]], max_bits: int) -> DataFrame:
    """(u, v, bits), u < v: each member's nearest candidate in its block of each bucket, by chains and Hamming distance.

    The others are left to ``cross_links``, so rows are no more than the buckets' members.
    """
    n = sum(map(len, layout[0])) // 64
    block = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / BLOCK).cast("long"))
    members = shared.join(fps.select("id", *_words_of(fps, n)), "id")
    rows = members.select("key", block.alias("block"), F.xxhash64("key", "id").alias("order"), "id", *(f"w{k}" for k in range(n)))

    check = _chain_check(layout, max_bits)

    def run(mat: np.ndarray) -> pd.DataFrame:
        i, j, bits = block_links(mat[:, 0], mat[:, 1], mat[:, 4:].view(np.uint64), check)
        if len(i):
            end, other = np.append(i, j), np.append(j, i)
            order = np.lexsort((other, np.append(bits, bits), end))
            best = np.unique(order[_spans(end[order])[:-1]] % len(i))
            i, j, bits = i[best], j[best], bits[best]
        a, b = mat[i, 3], mat[j, 3]
        return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b), "bits": bits})

    return _in_blocks(rows, run, "u long, v long, bits long", "key", "block").distinct()


def parity(hashes: np.ndarray) -> np.ndarray:
    """1,024 bits: whether classes of hashes have an odd number of members. Two sets differ in no fewer places."""
    return np.packbits((np.bincount((hashes & hashes.dtype.type(1023)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view(np.int64)


def _hopeful(q: int, at: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float) -> np.ndarray:
    """Of the rows ``at``, those that may be similar enough to row ``q`` by sizes and parities, the likeliest first; no other is."""
    at = at[np.minimum(sizes[at], sizes[q]) >= np.maximum(sizes[at], sizes[q]) * similarity]
    apart = np.bitwise_count((bits[at] ^ bits[q]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    near = apart <= (sizes[at] + sizes[q]) * (1 - similarity) / (1 + similarity) + 1e-6
    return at[near][np.argsort(apart[near], kind="stable")]


def _others(q: int, tile: dict[str, np.ndarray], label: np.ndarray) -> np.ndarray:
    """Held rows of other components; of two rows that are both asked, the one of the larger id asks."""
    return np.flatnonzero(tile["held"] & (label != label[q]) & (tile["main"] | (tile["id"] < tile["id"][q])))


def hopeful(tile: dict[str, np.ndarray], bits: np.ndarray, similarity: float) -> np.ndarray:
    """Ids of the tile that may be similar enough to one of another component."""
    mark = np.zeros(len(bits), dtype=bool)
    for q in np.flatnonzero(tile["asked"]):
        at = _hopeful(q, _others(q, tile, tile["root"]), tile["n"], bits, similarity)
        mark[at] = True
        mark[q] |= len(at) > 0
    return np.unique(tile["id"][mark])


def alike(tile: dict[str, np.ndarray], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that suffice to join all components with sets this similar, one held and one asked.

    Every pair of different components is compared, but those that earlier pairs have joined.
    """
    sizes, label, found = tile["n"], tile["root"].copy(), []
    bits = np.stack([parity(x) for x in sets])
    for q in np.flatnonzero(tile["asked"]):
        at, step = _hopeful(q, _others(q, tile, label), sizes, bits, similarity), 4
        while len(at):
            part, at, step = at[:step], at[step:], min(4 * step, 256)
            values = np.concatenate([sets[j] for j in part])
            hit = sets[q][np.minimum(np.searchsorted(sets[q], values), sizes[q] - 1)] == values
            both = np.add.reduceat(hit, np.append(0, np.cumsum(sizes[part])[:-1]), dtype=np.int64)
            for j in part[both >= (sizes[part] + sizes[q] - both) * similarity]:
                if label[j] != label[q]:
                    found.append((int(tile["root"][j]), int(tile["root"][q])))
                    label[label == label[j]] = label[q]
            at = at[label[at] != label[q]]
    return found


def _tiles(buckets: DataFrame, holds: DataFrame, roots: DataFrame, longs: Column):  # noqa: ANN202
    """Rows of ``buckets(key, id)`` with ``holds(id, n, ...)``, grouped in tiles in which all pairs of different components meet.

    Members outside the bucket's largest component are asked, in blocks, and meet all blocks of the bucket. ``longs``
    tells how many longs a row of so many n holds.
    """
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rooted = buckets.join(holds.select("id", "n"), "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", longs.alias("n"), F.coalesce("root", "id").alias("root"))
    rooted = staged(rooted, "rooted")
    per = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).where(F.col("top.c") < F.col("c"))
    asks = F.col("c") - F.col("top.c")
    # tiles for all tasks, neither tiny nor more than a task holds
    largest = F.least(F.lit(float(BLOCK)), F.lit(2.0**22) * F.col("c") / F.col("n"))
    side = F.greatest(F.lit(1.0), F.least(largest, F.greatest(F.lit(64.0), F.sqrt(F.col("c") * asks / (4.0 * parts)))))
    open_ = per.select("key", F.col("top.root").alias("top"), F.ceil(F.col("c") / side).cast("int").alias("blocks"), F.ceil(asks / side).cast("int").alias("asks"))
    deal = lambda of: F.pmod(F.xxhash64("id", "key"), F.col(of)).cast("int")
    rows = rooted.drop("n").join(open_, "key").withColumns({"main": F.col("root") == F.col("top"), "own": deal("blocks"), "own_ask": deal("asks")})
    held = F.transform(F.sequence(F.lit(0), F.col("asks") - 1), lambda a: F.struct(F.col("own").alias("block"), a.alias("ask")))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("own_ask").alias("ask")))
    places = F.when(F.col("main"), held).otherwise(F.array_union(held, asked))
    rows = rows.join(holds, "id").select("*", F.explode(places).alias("at"))
    marks = {"held": F.col("at.block") == F.col("own"), "asked": ~F.col("main") & (F.col("at.ask") == F.col("own_ask"))}
    return rows.select("key", "at.*", "id", "root", "main", *(v.alias(k) for k, v in marks.items()), *(c for c in holds.columns if c != "id")).groupBy("key", "block", "ask")


def _columns(tile: pa.Table) -> dict[str, np.ndarray]:
    return {c: tile.column(c).to_numpy() for c in ("id", "root", "main", "held", "asked", "n")}


def _lists(tile: pa.Table, name: str) -> list[np.ndarray]:
    lists = pa.concat_arrays(tile.column(name).chunks)
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def hopeful_rows(buckets: DataFrame, sketches: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """key, id: the rows of ``buckets`` that may be similar enough to one of another component, by ``sketches(id, n, bits)``; no other is."""

    def run(key: tuple, tile: pa.Table) -> pa.Table:
        ids = hopeful(_columns(tile), np.stack(_lists(tile, "bits")), similarity)
        return pa.table({"key": pa.array(np.full(len(ids), key[0].as_py()), pa.int64()), "id": pa.array(ids, pa.int64())})

    return _tiles(buckets, sketches, roots, F.lit(24)).applyInArrow(run, "key long, id long").distinct()


def cross_links(buckets: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v): roots to be joined, as the sets of two rows of one of ``buckets(key, id)`` have this similarity.

    No pair of different components is left out. A tile returns fewer links than it has rows.
    """

    def run(tile: pa.Table) -> pa.Table:
        found = alike(_columns(tile), _lists(tile, "hashes"), similarity)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return _tiles(buckets, sets, roots, F.col("n")).applyInArrow(run, "u long, v long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id: exact groups of 64-bit fingerprints within ``max_bits`` differing bits."""
    fps = staged(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", shingle).select("doc_id", "fp"), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Bits of the bitmap that spares most rows a shuffle; it is a filter only, an exact join follows.
BITMAP = 1 << 25


def _place(row: Column) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(BITMAP))


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits set at the places of all values of ``column``: ``BITMAP`` / 8 bytes, however many there are."""
    place = _place(F.col(column)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((BITMAP // 32768, 4096), dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[r["at"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bitmap's bits at these places are set."""
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _maybe(bits, row: Column) -> Column:  # noqa: ANN001
    """Whether ``row`` may be among the values of the broadcast bitmap ``bits``; false is certain."""
    test = F.pandas_udf(lambda at: pd.Series(_held(bits.value, at.to_numpy())), "boolean")
    return test(_place(row))


def shingle_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id, n, hashes: the sorted hashes of the distinct shingles of ``rows(row, text)`` for the rows of ``wanted(id, row)``.

    Texts are read, not shuffled: a bitmap of the wanted rows tells nearly all others apart.
    """
    found = _of_texts(rows, wanted, lambda x: np.sort(shingle_hashes(x, shingle).view(np.int64)))
    return staged(found.withColumn("n", F.size("hashes")), "sets")


def _of_texts(rows: DataFrame, wanted: DataFrame, hashed) -> DataFrame:  # noqa: ANN001
    """id, hashes: what ``hashed`` makes of the texts of ``wanted``."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "row"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_held(bits.value, batch.column("at").to_numpy())))
            made = [hashed(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, type=pa.list_(pa.int64()))], names=["row", "hashes"])

    found = rows.select("row", _place(F.col("row")).alias("at"), "text").mapInArrow(walk, "row binary, hashes array<long>")
    # repeated rows hold one text: any of them will do
    return wanted.join(found.groupBy("row").agg(F.first("hashes").alias("hashes")), "row").select("id", "hashes")


#: Counters of shingles, as a power of two at most, and how many go together.
COUNTERS, CHUNK = 22, 4096


def levels(rows: DataFrame, n_rows: int, shingle: int) -> np.ndarray:
    """How common shingles are in ``rows.text``: four steps per doubling, by the last bits of their hashes.

    Shingles share counters. That makes some look commoner than they are, which costs work in ``prefixes``, not links.
    """
    size = 1 << min(COUNTERS, max(12, (16 * n_rows).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            hashes = [shingle_hashes(x.as_py(), shingle) & np.uint64(size - 1) for x in batch.column("text")]
            at, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]), return_counts=True)
            counts[at.astype(np.int64)] += n
        for start in range(0, size, 64 * CHUNK):
            at = np.arange(start, min(size, start + 64 * CHUNK), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK, pa.int64()), pa.array([counts[i : i + CHUNK].tobytes() for i in at], pa.binary())], names=["chunk", "counts"])

    def total(table: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts")], axis=0)
        steps = np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk")[:1], "steps": pa.array([steps.tobytes()], pa.binary())})

    # few tasks: each returns all counters
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, 1 + (n_rows >> 13))
    counted = rows.select("text").coalesce(tasks).mapInArrow(count, "chunk long, counts binary")
    out = np.zeros((size // CHUNK, CHUNK), dtype=np.uint8)
    for r in counted.groupBy("chunk").applyInArrow(total, "chunk long, steps binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(bytes(r["steps"]), dtype=np.uint8)
    return out.ravel()


def prefix_length(n: int, similarity: float) -> int:
    """Of n shingles, so many hold one of any set this similar, in an order common to all sets."""
    return n - int(np.ceil(n * similarity - 1e-9)) + 1 if n else 0


def prefixes(rows: DataFrame, wanted: DataFrame, shingle: int, similarity: float, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(token, id, low, n) and (id, n, bits): the rarest shingles of the rows of ``wanted(id, row)`` that n > 1 of them share, low
    being the least id; and the size and parities of every row's set.

    Any two sets with this similarity share one of their rarest: the prefix filter, without loss.
    """
    common = rows.sparkSession.sparkContext.broadcast(levels(rows, n_rows, shingle))

    def rarest(text: str | None) -> np.ndarray:
        hashes = shingle_hashes(text, shingle)
        steps = common.value[(hashes & np.uint64(len(common.value) - 1)).astype(np.int64)]
        first = hashes[np.argsort(steps, kind="stable")[: prefix_length(len(hashes), similarity)]]
        return np.concatenate([[len(hashes)], parity(hashes), first.view(np.int64)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = staged(_of_texts(rows, wanted, rarest), "rarest")
    tokens = made.select("id", F.explode(F.slice("hashes", F.lit(18), F.size("hashes"))).alias("token")).repartition(parts, "token")
    same = Window.partitionBy("token")
    shared = tokens.select("token", "id", F.min("id").over(same).alias("low"), F.count("*").over(same).alias("n")).where("n > 1")
    return staged(shared, "prefixes"), made.select("id", F.col("hashes")[0].alias("n"), F.slice("hashes", 2, 16).alias("bits"))


def buckets_of(shared: DataFrame) -> DataFrame:
    """key, id: buckets that hold together every two ids of ``shared(token, id, low, n)`` with a common token.

    Ids that tokens connect make one bucket, where that takes fewer comparisons than a bucket for each token.
    Buckets of the same members are one.
    """
    linked = connected_components(shared.where("id <> low").select(F.col("low").alias("u"), F.col("id").alias("v")))
    placed = staged(shared.join(linked, F.col("low") == F.col("node"), "left").select("token", "id", "n", F.coalesce("root", "low").alias("whole")), "placed")
    members = placed.select("whole", "id").distinct()
    work = placed.groupBy("whole").agg(F.sum(F.col("n").cast("double")).alias("work"))
    fit = members.groupBy("whole").agg(F.count("*").cast("double").alias("c")).join(work, "whole")
    fit = fit.select("whole", (F.col("c") * F.col("c") <= F.greatest(F.col("work"), F.lit(4096.0))).alias("one"))
    wholes = members.join(fit.where("one"), "whole").select(F.xxhash64(F.lit(0), "whole").alias("key"), "id")
    rest = placed.join(fit.where("not one"), "whole").select("token", "id")
    marks = rest.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("b"))
    once = marks.groupBy("c", "a", "b").agg(F.min("token").alias("token")).select("token")
    # should two keys be equal, their buckets are compared as one
    return wholes.union(rest.join(once, "token").select(F.xxhash64(F.lit(1), "token").alias("key"), "id")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of ``pairs`` whose shingle sets have at least this Jaccard similarity; two empty sets are alike."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}"))
    sizes = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    fit = pairs.select("u", "v").join(sizes("u"), "u").join(sizes("v"), "v").where(F.least("nu", "nv") >= F.greatest("nu", "nv") * similarity).select("u", "v")
    both = F.size(F.array_intersect("hu", "hv"))
    return fit.join(side("u"), "u").join(side("v"), "v").where(both >= (F.col("nu") + F.col("nv") - both) * similarity).select("u", "v")


def near_duplicate_classes(distinct: DataFrame, rows: DataFrame, shingle: int, similarity: float, max_bits: int = WIDE_BITS) -> DataFrame:
    """(node, root) of ``distinct(id, row, words)``: the components of all pairs whose texts in ``rows`` are similar enough.

    Each row's two nearest candidates by fingerprint are verified first, which joins most of what belongs together.
    The prefix filter then finds every other pair; those between different components are compared.
    """
    fps = distinct.select("id", "words")
    n_rows = fps.count()
    m, n_rings = ring_plan(n_rows)
    layout = rings(256, n_rings, m)
    near = near_links(fps, shared_keys(fps, layout), layout, max_bits)
    both = staged(near, "near")
    both = both.select(F.col("u").alias("a"), F.col("v").alias("b"), "bits").union(both.select("v", "u", "bits"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))).where("r <= 2")
    first = staged(best.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "first")
    wanted = distinct.select("id", "row")
    ends = first.select(F.col("u").alias("id")).union(first.select("v")).distinct()
    roots = staged(connected_components(verified(first, shingle_sets(rows, wanted.join(ends, "id", "left_semi"), shingle), similarity)), "roots")
    shared, sketches = prefixes(rows, wanted, shingle, similarity, n_rows)
    # sets are long: parities first tell which are needed
    open_ = staged(hopeful_rows(buckets_of(shared), sketches, roots, similarity), "open")
    sets = shingle_sets(rows, wanted.join(open_.select("id").distinct(), "id", "left_semi"), shingle)
    joined = staged(cross_links(open_, sets, roots, similarity), "joined")
    later = connected_components(joined).select(F.col("node").alias("mid"), F.col("root").alias("top"))
    inner = roots.join(later, roots.root == later.mid, "left").select("node", F.coalesce("top", "root").alias("root"))
    known = later.join(roots, F.col("mid") == F.col("node"), "left_anti").select(F.col("mid").alias("node"), F.col("top").alias("root"))
    return inner.union(known)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row for each group of near duplicates: that of the smallest id, then of the smallest row hash.

    Wide mode on 256 bits, verified. Only texts are compared: rows of different texts stay apart though their ids
    are null or equal. A null id comes last. Rows that are kept and occur once are not shuffled.
    """
    small_batches(docs.sparkSession)
    whole = F.unhex(F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
    rows = docs.select(whole.alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketched = F.pandas_udf(lambda s: pd.DataFrame([sketch(x, shingle) for x in s], columns=["set", "words"]), "set binary, words array<long>")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("rank")
    fps = staged(rows.select(rank, sketched("text").alias("s")).select("rank", "s.*"), "simhash")
    copies = fps.groupBy("set").agg(F.min("rank").alias("rank"), F.min("words").alias("words"))
    distinct = staged(copies.withColumn("id", F.monotonically_increasing_id()).withColumn("row", F.col("rank.row")), "distinct")  # written once: the numbers stay
    roots = near_duplicate_classes(distinct, rows.select("row", "text"), shingle, similarity)
    rooted = distinct.select("id", "rank").join(roots, F.col("id") == F.col("node"), "left")
    keep = staged(rooted.groupBy(F.coalesce("root", "id")).agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("_quill_row")), "keep")
    counted = fps.groupBy(F.col("rank.row").alias("_quill_row")).agg(F.count("*").alias("n"))
    suspect = counted.join(keep.withColumn("kept", F.lit(True)), "_quill_row", "left").where("n > 1 or kept is null")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(suspect, "_quill_row"))
    marked = docs.withColumn("_quill_row", whole).withColumn("_quill_maybe", _maybe(bits, F.col("_quill_row")))
    sure = marked.where(~F.col("_quill_maybe"))
    rest = marked.where("_quill_maybe").join(keep, "_quill_row", "left_semi").dropDuplicates(["_quill_row"])
    return sure.unionByName(rest).drop("_quill_row", "_quill_maybe")
