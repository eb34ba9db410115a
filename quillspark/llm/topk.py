"""Exact top-k inner products by MaxScore over integer vectors.

Queries are dealt into blocks of bounded size. Each block is sent to all tasks,
which read the candidates where they lie, in shards of bounded size: candidates
are never shuffled or multiplied, and a task keeps k results a query. A query's
dimensions are its terms. A term's score bound in a shard is its best product
less its worst. Terms are split by these bounds: those whose bounds together
can't lift a vector over the k-th score so far, of this shard's sample or of the
task's shards before, are non-essential. Essential postings (columns) are
traversed for all vectors, for some queries together; non-essential ones are
probed, in descending bound, for vectors still competitive. The tasks' lists are
then merged.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part, as queries or candidates; an empty vector, like any other of fewer
components, is filled up with zeros; ties go to the smaller id; a null id takes
no part. Rows are told apart as rows: one that repeats an id is a candidate and,
if asked for, a query of its own, and only the query's own row is left out.
Components and scores may have any size: ranks are exact, and a score beyond 64
bits is given as the nearest long. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import new_path, staged

#: Components that a shard of candidates and a block of queries hold at most, and rows at most.
CELLS, SHARD, BLOCK = 1 << 21, 16384, 2048
#: Queries whose essential terms are traversed together, and the part of the threshold's height (one in
#: so many) that the non-essential terms may span: the less, the fewer vectors are probed.
TOGETHER, SPAN = 64, 4
_MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """The components as doubles, null if the vector takes no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.when(vector.isNotNull() & F.forall(vector, finite), F.transform(vector, lambda x: x.cast("double")))


def quantised(rows: np.ndarray, scale: int = 64) -> np.ndarray:
    """floor(scale * x), as doubles where these are exact (below 2 ** 50), else as Python integers."""
    if not rows.size or np.abs(rows).max() < 2.0**50 / scale:
        return np.floor(rows * scale)
    flat = [int(np.floor(x * scale)) if abs(x) < 2.0**60 else int(x) * scale for x in rows.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(rows.shape)


def _kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """A number type in which all inner products of these integers are exact."""
    if object in (rows.dtype, queries.dtype):
        return object
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _as(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape) if kind is object and x.dtype != object else x.astype(kind)


class Shard:
    """Vectors of one shard in order of id, with each term's least and greatest value."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((numbers, ids))
        self.ids, self.numbers, self.rows = ids[order], numbers[order], vectors[order]
        self.low, self.high = self.rows.min(0), self.rows.max(0)
        #: Products made, and those that a search without bounds makes.
        self.made = self.all = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (row positions, scores) of its best, k at most, no worse than ``least`` (or None); the row numbered ``own`` is left out."""
        kind = _kind(self.rows, queries)
        rows = _as(self.rows, kind)
        stride = max(1, len(rows) // 2048)
        seeds, seed_numbers = rows[::stride], self.numbers[::stride]
        low, high = _as(self.low, kind), _as(self.high, kind)
        for start in range(0, len(queries), TOGETHER):
            some = _as(queries[start : start + TOGETHER], kind)
            a, b = some * low, some * high
            worst, bound = np.minimum(a, b), np.abs(b - a)
            terms = np.argsort(-bound, axis=1, kind="stable")
            first = seeds @ some.T  # whole scores of a few vectors set the first thresholds
            self.made += first.size * some.shape[1]
            self.all += rows.size * len(some)
            masked = np.zeros_like(some)
            plans = []
            for j, query in enumerate(some):
                base = worst[j].sum()
                known = first[seed_numbers != own[start + j], j]
                floor = np.sort(known)[len(known) - k] if len(known) >= k else None
                if least[start + j] is not None:
                    floor = least[start + j] if floor is None else max(floor, least[start + j])
                rest = np.append(np.cumsum(bound[j][terms[j]][::-1])[::-1], 0)  # rest[i]: what terms i.. add at most over their worst
                # essential terms: all but a tail that can't lift a vector from its worst to the threshold
                essential = len(query) if floor is None else int(np.argmax(rest <= max(0, (floor - base) // SPAN)))
                used = terms[j][:essential]
                masked[j, used] = query[used]
                plans.append((floor, essential, rest))
            partial = rows @ masked.T
            for j, (floor, at, rest) in enumerate(plans):
                query, order = some[j], terms[j]
                self.made += at * len(rows)
                part, alive = partial[:, j], np.arange(len(rows))
                while True:
                    if floor is not None:  # still competitive if the terms left could reach the threshold
                        can = np.flatnonzero(part + (worst[j][order[at:]].sum() + rest[at]) >= floor)
                        alive, part = alive[can], part[can]
                    if at >= len(order):
                        break
                    step = order[at : at + max(8, (len(order) - at) // 2)]
                    part = part + rows[np.ix_(alive, step)] @ query[step]
                    self.made += len(alive) * len(step)
                    at += len(step)
                keep = self.numbers[alive] != own[start + j]
                alive, part = alive[keep], part[keep]
                if len(part) > 4 * k:
                    near = part >= np.sort(part)[len(part) - k]
                    alive, part = alive[near], part[near]
                best = np.argsort(-part, kind="stable")[:k]  # rows are in order of id already
                yield alive[best], part[best]


class Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, numbers: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.own = k, numbers
        self.queries = quantised(vectors)
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in numbers]  # (-score, id, row number)

    def see(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray) -> None:
        """Take a shard in, its rows and the queries of unusual size apart."""
        large_rows, large = (np.abs(x).max(axis=1, initial=0) >= 2**20 for x in (np.floor(vectors), self.queries))
        for rows in (~large_rows, large_rows):
            if not rows.any():
                continue
            shard = Shard(ids[rows], numbers[rows], quantised(vectors[rows]))
            for some in (np.flatnonzero(~large), np.flatnonzero(large)):
                least = [-self.found[q][-1][0] if len(self.found[q]) == self.k else None for q in some]
                for q, (at, scores) in zip(some, shard.search(self._some(some), self.own[some], self.k, least), strict=True):
                    new = [(-int(s), int(i), int(n)) for s, i, n in zip(scores, shard.ids[at], shard.numbers[at], strict=True)]
                    self.found[q] = sorted(self.found[q] + new)[: self.k]

    def _some(self, at: np.ndarray) -> np.ndarray:
        part = self.queries[at]
        small = part.dtype == object and all(abs(x) < 2**50 for x in part.ravel())
        return part.astype(np.float64) if small else part


def _digits(score: int) -> str:
    """A string that orders scores beyond 64 bits like their values."""
    if -_MOST <= score <= _MOST:
        return ""
    text = str(abs(score))
    text = f"{len(text):04d}{text}"
    return text if score > 0 else "".join(str(9 - int(c)) for c in text) + ":"


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the candidate's id, score: each query's k highest integer inner products."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # numbered and written once: the numbers stay
    clean = staged(clean.where("id is not null and v is not null").withColumn("number", F.monotonically_increasing_id()), "vectors")
    asked, dims = clean.agg(F.count_if("q"), F.max(F.size("v"))).first()
    dims = dims or 0
    per_block, per_shard = (max(1, min(n, CELLS // max(1, dims))) for n in (BLOCK, SHARD))
    blocks = 1 if (asked or 0) <= per_block else -(-2 * asked // per_block)  # twice as many, so that none grows past its bound by chance
    path, out = new_path(spark, "queries"), new_path(spark, "top")
    clean.where("q").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    asks = spark.read.schema("id long, v array<double>, q boolean, number long, block int").parquet(path)

    def matrix(values) -> np.ndarray:  # noqa: ANN001
        mat = np.zeros((len(values), dims))
        for i, row in enumerate(values):
            mat[i, : len(row)] = row
        return mat

    schema = "number long, query_id long, id long, other long, score long, digits string"
    for block in range(blocks):
        some = asks.where(F.col("block") == block).select("id", "number", "v").orderBy("number").collect()  # bounded by per_block
        if not some:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["number"] for r in some]), np.array([r["id"] for r in some]), matrix([r["v"] for r in some])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            own, ids, queries = sent.value
            best = Best(own, queries, k)
            held: list[pd.DataFrame] = []
            size = 0

            def see() -> None:
                shard = pd.concat(held)
                best.see(shard["id"].to_numpy(), shard["number"].to_numpy(), matrix(shard["v"]))
                held.clear()

            for batch in batches:
                for start in range(0, len(batch), per_shard):
                    part = batch.iloc[start : start + per_shard]
                    if held and size + len(part) > per_shard:
                        see()
                        size = 0
                    held.append(part)
                    size += len(part)
            if held:
                see()
            rows = [(number, q, i, n, max(-_MOST - 1, min(_MOST, -s)), _digits(-s)) for number, q, found in zip(own, ids, best.found, strict=True) for s, i, n in found]
            yield pd.DataFrame(rows, columns=["number", "query_id", "id", "other", "score", "digits"])

        order = Window.partitionBy("number").orderBy(F.desc("score"), F.desc("digits"), "id", "other")
        lists = clean.select("id", "number", "v").mapInPandas(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        lists.select("query_id", "rank", F.col("id").alias(id_col), "score").write.mode("append").parquet(out)
    if not asked:
        spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long").write.parquet(out)
    return spark.read.schema(f"query_id long, rank int, `{id_col}` long, score long").parquet(out)
