"""Joins, guards, packing, sampling, splits and metrics as DataFrame compositions.

Draws are hashes of (seed, key), so all results repeat; they match sequential
generators in distribution, not draw by draw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import exprs, udfs

#: The split that each purpose may read.
PURPOSE_SPLIT = {"train": "train", "cv": "train", "select": "validation", "threshold": "validation", "quantize": "validation", "route": "validation"}


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """O-56a: N:1 join on ``key`` that raises for a fact without its dimension row."""
    marked = dimension.withColumn("_found", F.lit(True))
    joined = facts.join(marked, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.coalesce("_found", missing)).drop("_found")


def authorised(records: DataFrame, split: DataFrame, purpose: str, key: str = "schedule_id", declared: str | None = None) -> DataFrame:
    """O-48, O-49: records with their split; one that the purpose may not read is an error, as is a column ``declared`` that
    states another split, and a cross-validation fold other than 0, 1, 2."""
    joined = with_dimension(records, split, key)

    def fails(when: Column, what: str) -> Column:
        return F.when(when, F.raise_error(F.concat(F.lit(f"{what}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)

    checks = F.lit(True)
    if declared:
        checks = checks & fails(F.col(declared).isNotNull() & (F.col(declared) != F.col("split")), "declared split differs")
    if purpose in PURPOSE_SPLIT:
        checks = checks & fails(~F.col("split").eqNullSafe(PURPOSE_SPLIT[purpose]), f"split not allowed for {purpose}")
    if purpose == "cv":
        checks = checks & fails(~F.coalesce(F.col("cv_fold").isin(0, 1, 2), F.lit(False)), "invalid fold")
    return joined.where(checks)


def for_purpose(records: DataFrame, split: DataFrame, purpose: str, key: str = "schedule_id") -> DataFrame:
    """O-17, O-18: the records that the purpose may read, the others left out; one unknown to ``split`` is an error."""
    joined = with_dimension(records, split, key)
    if purpose in PURPOSE_SPLIT:
        joined = joined.where(F.col("split") == PURPOSE_SPLIT[purpose])
    return joined.where(F.col("cv_fold").isin(0, 1, 2)) if purpose == "cv" else joined


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """O-62."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(df: DataFrame, key: str, *attributes: str) -> DataFrame:
    """O-75: keys whose rows disagree on an attribute."""
    wide = df.groupBy(key).agg(*(F.count_distinct(a).alias(f"n_{a}") for a in attributes))
    return wide.where(" or ".join(f"n_{a} > 1" for a in attributes))


def two_way_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """O-99: keys only in ``a`` (missing) and only in ``b`` (unexpected)."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("unexpected").alias("side")))


def nearest_anchor(df: DataFrame, value: Column, anchors: Sequence[int], name: str = "anchor") -> DataFrame:
    """O-56h: the anchor of least distance, the first listed in a tie; anchors are a short literal."""
    options = F.array(*(F.struct(F.abs(value - a).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(anchors)))
    return df.withColumn(name, F.array_min(options)["a"])


def runs(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """O-83: spans of consecutive equal values: partition, run number from 1, value, first and last position, length."""
    w = Window.partitionBy(*partition).orderBy(*order)
    numbered = df.withColumn("pos", F.row_number().over(w)).withColumn("new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("new", F.when(F.col("pos") == 1, 1).otherwise(F.col("new"))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*partition, "run").agg(F.first(value).alias(value), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("length"))


def pack_shards(sizes: DataFrame, max_groups: int, max_rows: int, partition: str = "split", key: str = "schedule_id", rows: str = "n") -> DataFrame:
    """O-60: greedy bins in order of key: a new one once a bin is full by groups, or the next would overflow its rows.

    A running sum with reset, folded over each partition's sorted (key, rows) pairs, which yields the
    positions where bins begin; a group larger than a bin gets one of its own. Input is one small row
    per group, not the groups' rows.
    """
    zero = F.lit(0).cast("bigint")
    state = F.struct(zero.alias("i"), zero.alias("groups"), zero.alias("rows"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["groups"] >= max_groups) | ((acc["groups"] > 0) & (acc["rows"] + n > max_rows))
        return F.struct((acc["i"] + 1).alias("i"), F.when(full, F.lit(1).cast("bigint")).otherwise(acc["groups"] + 1).alias("groups"), F.when(full, n).otherwise(acc["rows"] + n).alias("rows"), F.when(full, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"))

    order = Window.partitionBy(partition).orderBy(key)
    numbered = sizes.select(partition, key, F.col(rows).cast("bigint").alias(rows)).withColumn("_i", (F.row_number().over(order) - 1).cast("bigint"))
    folded = numbered.groupBy(partition).agg(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("_i", rows))), lambda x: x[rows]), state, step)["starts"].alias("_starts"))
    starts = folded.select(partition, F.explode("_starts").alias("_i"), F.lit(1).alias("_new"))
    running = Window.partitionBy(partition).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.join(starts, [partition, "_i"], "left").withColumn("shard", F.sum(F.coalesce("_new", F.lit(0))).over(running).cast("int")).select(partition, key, rows, "shard")


def even_quota(df: DataFrame, seed: int, key: str, chosen: int, total: int) -> DataFrame:
    """O-88: the ``chosen`` keys of least hash share ``total`` evenly, the first ones taking the remainder."""
    order = Window.orderBy("h", key)
    top = df.select(key, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h")).orderBy("h", key).limit(chosen)
    return top.withColumn("rn", F.row_number().over(order)).select(key, (F.lit(total // chosen) + (F.col("rn") <= total % chosen).cast("int")).cast("bigint").alias("quota"))


def capped_weighted_sample(df: DataFrame, seed: int, key: Sequence[str], group: str, weight: Column, cap: int) -> DataFrame:
    """O-164: weighted draw without replacement, ``cap`` a group: least -ln(u) / weight."""
    u = F.greatest(exprs.uniform(seed, *(F.col(k) for k in key)), F.lit(2.0**-49))
    drawn = df.withColumn("_draw", -F.ln(u) / weight)
    order = Window.partitionBy(group).orderBy("_draw", *key)
    return drawn.withColumn("draw_rank", F.row_number().over(order)).where(F.col("draw_rank") <= cap).drop("_draw")


def weighted_picks(draws: DataFrame, draw: Column, weights: DataFrame, key: str, weight: str) -> DataFrame:
    """O-160: with replacement: for each uniform ``draw``, the ``key`` in whose stretch of the cumulative weights it falls.

    Stretches are cut at the borders of as many equal buckets as there are keys, so that draws meet
    them through an equi-join on the bucket. Only the weights' own running sum is in one order.
    """
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    marked = weights.select(F.col(key), F.col(weight).cast("double").alias("_w")).withColumn("_hi", F.sum("_w").over(order))
    total, n = marked.agg(F.sum("_w"), F.count("*")).first()
    if not n or not total:
        raise ValueError("no weights")
    width = total / n
    bucket = lambda x: F.least(F.floor(x / width), F.lit(n - 1))
    spans = marked.withColumn("_lo", F.col("_hi") - F.col("_w")).where("_w > 0")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    at = draws.withColumn("_at", draw * total).withColumn("_bucket", bucket(F.col("_at")))
    return at.join(spans, "_bucket").where("_at >= _lo and _at < _hi").drop("_bucket", "_at", "_lo", "_hi", "_w")


def batches(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """O-165, O-166: batch numbers of ``size`` rows within each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def hamilton_seats(counts: Mapping[tuple, int], ratios: Sequence[tuple[str, float]], seed: int) -> dict[tuple, dict[str, int]]:
    """O-150: seats of each stratum by split. Floors first, in binary floating point; then single seats by
    descending (fraction, hash, stratum, split), within each stratum's free places and the splits' totals.

    Totals of all splits but the last are half-even, the last takes the rest. Runs on the driver over strata.
    """
    import hashlib

    total = sum(counts.values())
    goal = {s: round(total * r) for s, r in ratios[:-1]}
    goal[ratios[-1][0]] = total - sum(goal.values())
    seats = {k: {s: int(r * n) for s, r in ratios} for k, n in counts.items()}
    left = {k: n - sum(seats[k].values()) for k, n in counts.items()}
    want = {s: goal[s] - sum(v[s] for v in seats.values()) for s, _ in ratios}
    mark = lambda k, s: hashlib.sha256(f"{seed}:{k!r}:{s}".encode()).hexdigest()
    queue = sorted(((r * n - int(r * n), mark(k, s), k, s) for k, n in counts.items() for s, r in ratios), key=lambda x: (x[0], x[1], str(x[2]), x[3]), reverse=True)
    while any(left.values()):
        moved = False
        for _, _, k, s in queue:
            if left[k] > 0 and want[s] > 0:
                seats[k][s] += 1
                left[k] -= 1
                want[s] -= 1
                moved = True
        if not moved:
            raise ValueError("no split has a place left")
    return seats


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], seed: int, ratios: Sequence[tuple[str, float]] = (("train", 0.7), ("validation", 0.15), ("test", 0.15))) -> DataFrame:
    """O-150, O-151: leakage-safe split; within a stratum, keys in order of hash fill the seats. Adds split and cv_fold.

    Only strata's counts reach the driver.
    """
    stratum = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in strata))
    keyed = df.withColumn("_stratum", stratum)
    counts = {tuple(r["_stratum"].split("\x1f")): r["count"] for r in keyed.groupBy("_stratum").count().collect()}
    seats = hamilton_seats(counts, ratios, seed)
    rows = [("\x1f".join(k), *(sum(seats[k][s] for s, _ in ratios[: i + 1]) for i in range(len(ratios)))) for k in seats]
    limits = df.sparkSession.createDataFrame(rows, ", ".join(["_stratum string", *(f"_upto{i} long" for i in range(len(ratios)))]))
    order = Window.partitionBy("_stratum").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    numbered = keyed.withColumn("_rn", F.row_number().over(order)).join(F.broadcast(limits), "_stratum")
    name = F.lit(ratios[-1][0])
    for i in reversed(range(len(ratios) - 1)):
        name = F.when(F.col("_rn") <= F.col(f"_upto{i}"), ratios[i][0]).otherwise(name)
    out = numbered.withColumn("split", name).withColumn("cv_fold", F.when(F.col("split") == "train", exprs.cv_fold(seed, F.col(key))).otherwise(-1))
    return out.drop("_stratum", "_rn", *(f"_upto{i}" for i in range(len(ratios))))


def checksum_limbs(df: DataFrame, canonical: Column) -> DataFrame:
    """O-74: order-independent multiset checksum as one row: n, and of each row's SHA-256 the XOR and sum by 32-bit limb.

    Limb sums merge in any order; ``finish_checksum`` carries them. Sums are exact up to 2 ** 31 rows per limb of 32 bits.
    """
    limbs = df.select(F.sha2(canonical, 256).alias("h")).select(*(F.conv(F.substr("h", F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint").alias(f"l{i}") for i in range(8)))
    return limbs.agg(F.count("*").alias("n"), *(F.bit_xor(f"l{i}").alias(f"x{i}") for i in range(8)), *(F.sum(F.col(f"l{i}").cast("decimal(38,0)")).cast("bigint").alias(f"s{i}") for i in range(8)))


def finish_checksum(row) -> str:  # noqa: ANN001
    """The final SHA-256 of count, XOR and sum modulo 2 ** 256."""
    import hashlib

    xor = sum((row[f"x{i}"] or 0) << (32 * (7 - i)) for i in range(8))
    total = sum((row[f"s{i}"] or 0) << (32 * (7 - i)) for i in range(8)) % 2**256
    return hashlib.sha256(f"{row['n']}:{xor:064x}:{total:064x}".encode()).hexdigest()


def last_by_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of rows that share a key the last by ``order``, as a mapping built in that order would keep."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_rn = 1").drop("_rn")


def evaluate_cells(truth: DataFrame, prediction: DataFrame, order: Column | None = None) -> DataFrame:
    """O-67: one row of accuracies from (schedule_id, row_index, day, text), truth with ``ignore``.

    Of rows that repeat a key the last by ``order`` counts, by default the last read.

    Full outer join on the key, then rows and schedules are exact if all their cells are. Ratios have
    a denominator of 1 at least. A prediction without truth (ignored truth included) is a false positive.
    """
    key = ["schedule_id", "row_index", "day"]
    order = F.monotonically_increasing_id() if order is None else order
    latest = lambda df: df.withColumn("_at", order).groupBy(*key).agg(F.max_by("text", "_at").alias("text"))
    t = latest(truth.where(~F.coalesce(F.col("ignore"), F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))).withColumnRenamed("text", "truth")
    p = latest(prediction.withColumn("text", F.coalesce("text", F.lit("")))).withColumnRenamed("text", "found")
    joined = t.join(p, key, "full_outer")
    cells = joined.where("truth is not null").select(
        "schedule_id", "row_index", F.coalesce(F.col("truth") == F.col("found"), F.lit(False)).alias("exact"),
        F.levenshtein("truth", F.coalesce("found", F.lit(""))).alias("edits"), F.length("truth").alias("chars"),
    )
    rows = cells.groupBy("schedule_id", "row_index").agg(F.bool_and("exact").alias("row_ok"), F.count("*").alias("n"), F.count_if("exact").alias("ok"), F.sum("edits").alias("edits"), F.sum("chars").alias("chars"))
    schedules = rows.groupBy("schedule_id").agg(F.bool_and("row_ok").alias("all_ok"), F.count("*").alias("rows"), F.count_if("row_ok").alias("rows_ok"), *(F.sum(c).alias(c) for c in ("n", "ok", "edits", "chars")))
    extra = joined.where("truth is null").agg(F.count("*").alias("false_positives"))
    share = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 9)
    total = schedules.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.coalesce(F.sum("edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("rows_ok"), F.lit(0)).alias("rows_ok"), F.count("*").alias("schedules"), F.count_if("all_ok").alias("schedules_ok"))
    both = total.join(extra)  # one row each
    return both.select("cells", share(F.col("ok"), F.col("cells")).alias("cell_exact"), share(F.col("edits"), F.col("chars")).alias("cer"), share(F.col("rows_ok"), F.col("rows")).alias("row_accuracy"), share(F.col("schedules_ok"), F.col("schedules")).alias("schedule_accuracy"), "false_positives")


def bootstrap_interval(values: DataFrame, value: str, order: str, rounds: int = 2000, seed: int = 20260723) -> DataFrame:
    """O-79: mean and 95 % interval over hashed resamples with replacement; zeros if empty.

    ``values`` are per-schedule figures, gathered as one array, on which each round draws: rounds in parallel.
    """
    packed = values.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    spread = packed.crossJoin(values.sparkSession.range(rounds).withColumnRenamed("id", "r"))
    n = F.size("v")
    draws = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get("v", (exprs.hex_prefix(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), i.cast("string")), 8) % n).cast("int")))
    means = spread.where(n > 0).select(F.round(F.aggregate(draws, F.lit(0.0), lambda a, x: a + x) / n, 9).alias("m"))
    sorted_means = means.agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.get("m", F.lit(int(0.025 * (rounds - 1)))).alias("low"), F.get("m", F.lit(-int(-0.975 * (rounds - 1) // 1))).alias("high"))
    mean = values.agg(F.round(F.avg(value), 9).alias("mean"))
    return mean.join(sorted_means).select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "low", "high")))


#: The routes, the one compared with, and those that may replace it.
ROUTES, ROUTE_BASELINE, ROUTE_CANDIDATES = ("A", "B", "C", "D"), "D", ("A", "C")


def choose_route(results: DataFrame, loss: float = 0.005, gain: float = 0.15) -> DataFrame:
    """O-94: of the candidates that lose at most ``loss`` accuracy against the baseline and save ``gain`` of its latency or
    memory, that of least (latency, memory); if there is none, of all routes the most accurate, then fastest, then smallest.

    Exactly the four routes are asked for, with validation results; else an error. One row a route.
    """
    given = results.agg(F.sort_array(F.collect_list("route")).alias("routes"), F.bool_and(F.col("split").eqNullSafe("validation")).alias("ok"))
    checked = results.join(given)  # one row
    wrong = F.raise_error(F.lit("route selection takes validation results of each of the four routes")).cast("boolean")
    checked = checked.where(F.when((F.col("routes") == F.array(*map(F.lit, ROUTES))) & F.col("ok"), True).otherwise(wrong))
    base = results.where(F.col("route") == ROUTE_BASELINE).select(F.col("accuracy").alias("a0"), F.col("p95").alias("p0"), F.col("mem").alias("m0"))
    saved = F.greatest(1 - F.col("p95") / F.greatest(F.lit(1e-9), "p0"), 1 - F.col("mem") / F.greatest(F.lit(1e-9), "m0"))
    fit = F.col("route").isin(*ROUTE_CANDIDATES) & (F.col("a0") - F.col("accuracy") <= loss) & (saved >= gain)
    frugal = F.min_by(F.when(fit, F.col("route")), F.when(fit, F.struct("p95", "mem", "route")))
    accurate = F.min_by("route", F.struct(-F.col("accuracy"), "p95", "mem", "route"))
    return checked.join(base).agg(F.coalesce(frugal, accurate).alias("route"))


def choose_profile(results: DataFrame, max_loss: float = 0.005) -> DataFrame:
    """O-95: of usable profiles within ``max_loss`` (missing loss counts as 1), that of least (latency, memory, size).

    A ``split`` column must say validation throughout; that nothing fits is an error.
    """
    if "split" in results.columns:
        wrong = F.raise_error(F.lit("profile selection takes validation results only")).cast("boolean")
        results = results.where(F.when(F.col("split").eqNullSafe("validation"), True).otherwise(wrong))
    fit = F.coalesce("usable", F.lit(True)) & (F.coalesce("accuracy_loss", F.lit(1.0)) <= max_loss)
    found = results.where(fit).agg(F.min_by("profile", F.struct("p95", "mem", "size", "profile")).alias("profile"))
    return found.select(F.coalesce("profile", F.raise_error(F.lit("no profile within the permitted loss"))).alias("profile"))


def running_best(epochs: DataFrame, partition: str, order: str, metric: str, tie: str, mode: str = "max") -> DataFrame:
    """O-96: the first epoch that no later one beats: better metric (higher, or lower in mode min), or an equal one (to 1e-9 relative) with a lower tie-breaker."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode}")
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("e"), F.col(metric).alias("m"), F.col(tie).alias("t"))))

    def better(acc: Column, x: Column) -> Column:
        same = F.abs(acc["m"] - x["m"]) <= F.greatest(F.lit(1e-12), 1e-9 * F.greatest(F.abs(acc["m"]), F.abs(x["m"])))
        return F.when(F.when(same, x["t"] < acc["t"]).otherwise(x["m"] > acc["m"] if mode == "max" else x["m"] < acc["m"]), x).otherwise(acc)

    return epochs.groupBy(partition).agg(items.alias("i")).select(partition, F.aggregate(F.slice("i", 2, F.size("i")), F.col("i")[0], better).alias("b")).select(partition, F.col("b.e").alias("epoch"), F.col("b.m").alias("metric"))


def partition_equivalent(df: DataFrame, a: str, b: str) -> DataFrame:
    """O-156: whether two labelings group rows alike: as many pairs as labels on either side."""
    return df.select(a, b).distinct().agg((F.count("*") == F.count_distinct(a)).alias("x"), (F.count("*") == F.count_distinct(b)).alias("y")).select((F.col("x") & F.col("y")).alias("equivalent"))


def char_coverage(df: DataFrame, text: Column, charset: DataFrame) -> DataFrame:
    """O-65: each character's frequency and whether it is in ``charset.ch``."""
    chars = df.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.join(charset.select("ch").distinct().withColumn("known", F.lit(True)), "ch", "left").select("ch", "n", F.coalesce("known", F.lit(False)).alias("in_charset"))


def canonicalise(df: DataFrame, text: str, codes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """O-105: ``canonical`` of the stripped, NFC-composed text: by alias, by exact spelling, by case-folded spelling (the last code listed wins), else null.

    ``codes(code, ord)``; ``aliases(alias, code)`` are matched case-folded and go before all else.
    """
    fold = lambda c: udfs.casefold(udfs.nfc(F.trim(c)))
    exact = codes.select(F.col("code").alias("_exact"), F.col("code").alias("_by_exact")).distinct()
    folded = codes.groupBy(fold(F.col("code")).alias("_fold")).agg(F.max_by("code", "ord").alias("_by_fold"))
    cleaned = df.withColumn("_text", udfs.nfc(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))
    cleaned = cleaned.withColumn("_key", udfs.casefold(F.col("_text")))
    joined = cleaned.join(exact, F.col("_text") == F.col("_exact"), "left").join(folded, F.col("_key") == F.col("_fold"), "left")
    found = F.coalesce("_by_exact", "_by_fold")
    if aliases is not None:
        named = aliases.groupBy(fold(F.col("alias")).alias("_alias")).agg(F.max("code").alias("_by_alias"))
        joined, found = joined.join(named, F.col("_key") == F.col("_alias"), "left"), F.coalesce("_by_alias", found)
    return joined.withColumn("canonical", found).drop("_text", "_key", "_exact", "_by_exact", "_fold", "_by_fold", "_alias", "_by_alias")


def cv_partition(records: DataFrame, fold: Column, held_out: int, split: str = "split") -> DataFrame:
    """``records`` with ``role``: validation in the held-out fold, else train. A row outside the train split is an error."""
    outside = F.raise_error(F.concat(F.lit("not a train row: split "), F.coalesce(F.col(split), F.lit("null"))))
    return records.withColumn("role", F.when(~F.col(split).eqNullSafe("train"), outside).when(fold == held_out, "validation").otherwise("train"))


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The distinct values of each key and the place of their first occurrence, from 1 (ties in ``order`` to the smaller value)."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first", value)))


def mixed_groups(df: DataFrame, group: Column, attribute: str) -> DataFrame:
    """Groups that hold other than one value of ``attribute``; an empty result means that all are uniform."""
    return df.groupBy(group.alias("batch")).agg(F.countDistinct(attribute).alias("n_values")).where("n_values <> 1")


def filled_from(records: DataFrame, expected: DataFrame, key: str, attribute: str) -> DataFrame:
    """Each record's attribute, filled from the expected row where null, and ``conflict`` where both are stated and differ."""
    joined = records.join(expected.select(key, F.col(attribute).alias("_expected")), key, "left")
    conflict = F.coalesce(F.col(attribute) != F.col("_expected"), F.lit(False))
    return joined.withColumn("conflict", conflict).withColumn(attribute, F.coalesce(attribute, "_expected")).drop("_expected")


def dataset_plan(ids: DataFrame, root_seed: int, templates: Sequence[str], prefix: str, most_people: int = 32) -> DataFrame:
    """Plan rows for ``ids`` (a column ``id`` from 1): templates in turn, a seed from the id, hashed month and people count."""
    name = F.concat(F.lit(f"{prefix}_"), F.when(F.col("id") < 10_000, F.lpad(F.col("id").cast("string"), 4, "0")).otherwise(F.col("id").cast("string")))
    seed = exprs.seed_of(root_seed, F.col("schedule_id"))
    turn = F.element_at(F.array(*map(F.lit, templates)), ((F.col("id") - 1) % len(templates) + 1).cast("int"))
    draws = {"month": (F.lit(1), 12), "people_count": (F.lit(18), most_people - 17)}
    plan = ids.select("id", name.alias("schedule_id")).withColumn("seed", seed).withColumn("template_id", turn)
    for column, (least, n) in draws.items():
        plan = plan.withColumn(column, least + (exprs.hex_prefix(F.concat_ws(":", "seed", F.lit(column)), 8) % n).cast("int"))
    return plan


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """O-103: rows of ``columns`` that the two encodings hold in different numbers, and both counts; empty if they are equal."""
    both = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(*columns, F.lit(0), F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b")).where("n_a <> n_b")


def verified_scan(df: DataFrame, canonical: Column, expected: str) -> DataFrame:
    """O-05: ``df`` after a full pass that finds its checksum as ``expected``; else an error before any row is read."""
    found = finish_checksum(checksum_limbs(df, canonical).first())
    if found != expected:
        raise ValueError(f"checksum {found}, expected {expected}")
    return df


def missing_from(needed: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """O-102: the keys of ``needed`` that ``given`` lacks; empty if it covers them."""
    return needed.select(key).distinct().join(given.select(key), key, "left_anti")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """O-102: ``df`` if it has all ``columns``."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns {lacking}")
    return df


def unnest_rows(schedules: DataFrame, rows: str, parents: Sequence[str], ordinal: str = "row_no") -> DataFrame:
    """O-33: one row per element of the array ``rows``, with its ordinal from 1 and the parent's columns."""
    spread = schedules.select(*parents, F.posexplode(rows).alias("_pos", "_row"))
    return spread.select(*parents, (F.col("_pos") + 1).alias(ordinal), "_row.*")


def all_families(*parts: DataFrame) -> DataFrame:
    """O-101, O-28: the rows of all parts, columns by name, absent ones null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def known_ids(truth: DataFrame, prediction: DataFrame, key: str) -> DataFrame:
    """O-100: ids that either side has."""
    return truth.select(key).union(prediction.select(key)).distinct()


def with_metadata(annotations: DataFrame, metadata: DataFrame, key: str = "schedule_id") -> DataFrame:
    """O-56f: annotations with their shard metadata; one without is an error."""
    return with_dimension(annotations, metadata, key)


def or_jitter(truth: DataFrame, predicted: DataFrame, key: str, box: str, least_iou: float = 0.45, least_confidence: float = 0.35) -> DataFrame:
    """O-56i: each truth cell with the predicted box if that is good enough (``gt_iou``, ``confidence``), else marked for jitter."""
    good = predicted.where((F.col("gt_iou") >= least_iou) & (F.col("confidence") >= least_confidence)).select(key, F.col(box).alias("_found"))
    joined = truth.join(good, key, "left")
    return joined.withColumn("box_source", F.when(F.col("_found").isNotNull(), "prediction").otherwise("jitter")).withColumn(box, F.coalesce("_found", box)).drop("_found")


def registration_accepted(checks: Sequence[Column]) -> Column:
    """O-52: whether all checks hold; an unknown one doesn't."""
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out
