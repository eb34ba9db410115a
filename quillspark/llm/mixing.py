"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame code only.

Sources share a total of words by weight, none above a limit times its own size
(the excess is reshared by weight). A document of a source is to be taken
target / source_size times; the fraction is a probability to be rounded. Pivotal
rounding pairs two probabilities and moves mass from one to the other, either
way at random, until one is 0 or 1. The mass moved is measured in words, so a
source's taken words stay at its target up to one document's size, and each
document keeps its probability.

The pairing is a reduction tree: documents are dealt by hash into blocks of
about ``BLOCK``; a fold over each block settles all but one, and the blocks'
residuals go to the next level. Levels grow with log(rows) / log(BLOCK). Draws
are hashes of a seed and ids, so reruns agree.

Defined results: a null or blank text has size 0 and is taken as often as the
whole part says, for no words; a null source is a source of its own, last in
order; null ids are allowed; rows that repeat an id are dealt, rounded and
repeated one by one, told apart by a number that is written with them (which
depends on how the input is split; all others draw by their ids alone); an empty table gives
an empty result; other columns are ignored by ``draws`` and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import staged

BLOCK = 256
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, n, source_size, target: shares by weight, capped at ``limit`` times the size, excess reshared.

    Works on one row per source. With sources in order of cap / weight, those at
    the front are full while the level that the rest would get reaches their cap.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    listed = F.array(*(F.lit(float(w)) for w in weights))
    weighted = totals.withColumn("w", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    weighted = weighted.withColumns({"cap": F.col("source_size") * limit, "budget": F.sum("source_size").over(everything) * share})
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levelled = weighted.withColumns({"level": level, "at": F.row_number().over(order)})
    is_free = F.col("level") * F.col("w") < F.col("cap")
    final = F.min_by(F.when(is_free, F.col("level")), F.when(is_free, F.col("at"))).over(everything)
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("w")))
    return levelled.select("source", "n", "source_size", target.alias("target"))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _uniform(seed: int, *cols: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


#: id, number if the id repeats (else 0), size, probability, number.
_ITEM = "struct<id:bigint,r:bigint,s:bigint,p:double,n:bigint>"
_STATE = f"struct<has:boolean,c:{_ITEM},out:array<struct<id:bigint,n:bigint,s:bigint,k:int>>>"


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of items: struct of the last residual ``c`` and the settled ``out``."""

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["r"].alias("r"), x["s"].alias("s"), p.alias("p"), x["n"].alias("n"))

    def settled(x: Column, k: int) -> Column:
        return F.array(F.struct(x["id"].alias("id"), x["n"].alias("n"), x["s"].alias("s"), F.lit(k).alias("k")))

    def state(c: Column, out: Column) -> Column:
        return F.struct(F.lit(True).alias("has"), c.alias("c"), out.alias("out")).cast(_STATE)

    def meet(acc: Column, b: Column) -> Column:
        a = acc["c"]
        have_a, have_b = a["p"] * a["s"], b["p"] * b["s"]
        room_a, room_b = a["s"] - have_a, b["s"] - have_b
        both = F.struct(
            have_a.alias("ha"), have_b.alias("hb"), room_a.alias("ra"), room_b.alias("rb"),
            F.least(room_a, have_b).alias("up"), F.least(have_a, room_b).alias("down"), _uniform(seed, a["id"], a["r"], b["id"], b["r"]).alias("u"),
        )

        def moved(m: Column) -> Column:
            raise_a = m["u"] * (m["up"] + m["down"]) < m["down"]
            a_full, a_none = m["ra"] <= m["hb"], m["ha"] <= m["rb"]
            return (
                F.when(raise_a & a_full, state(item(b, (m["hb"] - m["up"]) / b["s"]), F.concat(acc["out"], settled(a, 1))))
                .when(raise_a, state(item(a, (m["ha"] + m["up"]) / a["s"]), F.concat(acc["out"], settled(b, 0))))
                .when(a_none, state(item(b, (m["hb"] + m["down"]) / b["s"]), F.concat(acc["out"], settled(a, 0))))
                .otherwise(state(item(a, (m["ha"] - m["down"]) / a["s"]), F.concat(acc["out"], settled(b, 1))))
            )

        return _let(both, moved)

    start = F.struct(F.lit(False).alias("has"), F.lit(None).cast(_ITEM).alias("c"), F.array().alias("out")).cast(_STATE)
    return F.aggregate(items, start, lambda acc, x: F.when(acc["has"], meet(acc, x)).otherwise(state(x, acc["out"])))


def _numbered_draws(sizes: DataFrame, weights: Sequence[float], share: float, limit: float, seed: int) -> DataFrame:
    """number, id, size, source_size, target, copies for the rows of ``sizes(number, id, source, size)``."""
    plan = staged(targets(sizes, weights, share, limit), "targets").withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumns({"whole": F.floor("f").cast("int"), "part": F.col("f") - F.floor("f")})
    most = plan.agg(F.max("n")).first()[0] or 0
    repeated = sizes.groupBy(F.col("id").alias("twice")).agg(F.count("*").alias("c")).where("c > 1").select("twice", F.lit(True).alias("repeats"))
    marked = sizes.join(repeated, F.col("id").eqNullSafe(F.col("twice")), "left").withColumn("r", F.when(F.col("repeats"), F.col("number")).otherwise(0))
    rows = marked.alias("d").join(plan.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("id", "r", "number", "d.source", "size", "n", "whole", "part")
    open_ = (F.col("part") > 0) & (F.col("size") > 0)
    sure = rows.where(~open_).select("id", "number", "source", F.col("size").alias("s"), F.lit(0).alias("k"))
    item = F.struct("id", "r", F.col("size").alias("s"), F.col("part").alias("p"), F.col("number").alias("n"))
    level = rows.where(open_).select("source", "n", item.alias("x"))
    done = [sure]
    depth = 0
    while most > 0:
        last = most <= BLOCK
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        block = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("x.id", "x.r", "x.s", F.lit(depth)), blocks)
        grouped = level.groupBy("source", "n", block.alias("block")).agg(F.sort_array(F.collect_list("x")).alias("items"))
        folded = staged(grouped.select("source", blocks.alias("n"), _fold(F.col("items"), seed + depth).alias("r")), "rounded")
        done.append(folded.select("source", F.explode("r.out").alias("o")).select("o.id", F.col("o.n").alias("number"), "source", "o.s", "o.k"))
        rest = folded.select("source", "n", F.col("r.c").alias("x"))
        if last:
            chance = _uniform(seed - 1, F.col("x.id"), F.col("x.r"), F.col("x.s")) < F.col("x.p")
            done.append(rest.select("x.id", F.col("x.n").alias("number"), "source", "x.s", chance.cast("int").alias("k")))
            break
        level, most, depth = rest, -(-most // BLOCK), depth + 1
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    taken = every.alias("e").join(plan.alias("t"), F.col("e.source").eqNullSafe(F.col("t.source")))
    return taken.select("number", "id", F.col("s").alias("size"), "source_size", "target", (F.col("whole") + F.col("k")).alias("copies"))


def draws(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 17, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: how often the mix takes each row, and its words."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = staged(own.withColumn("number", F.monotonically_increasing_id()), "sizes")  # written once: the numbers stay
    drawn = _numbered_draws(sizes, weights, share, limit, seed)
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = staged(docs.withColumn("_quill_number", F.monotonically_increasing_id()), "rows")  # written once: the numbers stay
    sizes = rows.select(F.col("_quill_number").alias("number"), F.col(id_col).cast("long").alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    drawn = _numbered_draws(staged(sizes, "sizes"), WEIGHTS, SHARE, LIMIT, seed)
    copies = drawn.where("copies > 0").select(F.col("number").alias("_quill_number"), F.col("copies").alias("_quill_copies"))
    joined = rows.join(copies, "_quill_number")
    return joined.withColumn("_quill_copy", F.explode(F.sequence(F.lit(1), F.col("_quill_copies")))).drop("_quill_number", "_quill_copies", "_quill_copy")
