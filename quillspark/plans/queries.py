"""Named queries over the test tables. Each is registered with its DuckDB SQL, where SQL can express it.

The reference operations' own inputs (schedules, cells, quads) are derived from the tables:
orders stand for schedules, lineitem rows for cells, hashed offsets for boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import exprs, udfs
from quillspark.operators import grouped
from quillspark.operators import relational as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Step 1: hashes, quotas, histograms


@query("SELECT (('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::BIGINT % 3)::INTEGER AS fold, count(*) AS n FROM orders GROUP BY 1")
def cv_fold_counts(spark, sf):
    """O-117."""
    return table(spark, sf, "orders").groupBy(exprs.cv_fold(7, F.col("o_orderkey")).alias("fold")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, ('0x' || substr(sha256('11:' || o_orderkey), 1, 15))::BIGINT AS seed FROM orders")
def schedule_seed_bits(spark, sf):
    """O-116."""
    return table(spark, sf, "orders").select("o_orderkey", exprs.seed_of(11, F.col("o_orderkey")).alias("seed"))


@query("""
    WITH t AS (SELECT c_custkey, sha256('5:' || c_custkey) AS h FROM customer ORDER BY h, c_custkey LIMIT 40)
    SELECT c_custkey, 150 // 40 + (row_number() OVER (ORDER BY h, c_custkey) <= 150 % 40)::BIGINT AS quota FROM t
""")
def capture_quota_topk(spark, sf):
    """O-88: a top-k by hash, so the limit is the feature."""
    return rel.even_quota(table(spark, sf, "customer"), 5, "c_custkey", 40, 150)


@query("""
    SELECT o_orderstatus, o_orderpriority, bucket, count(*) AS n, GROUPING(o_orderstatus, o_orderpriority, bucket)::BIGINT AS g
    FROM (SELECT o_orderstatus, o_orderpriority, CASE WHEN k <= 20 THEN 'small' WHEN k <= 27 THEN 'medium' ELSE 'large' END AS bucket
          FROM (SELECT *, o_custkey % 40 AS k FROM orders)) GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (bucket))
""")
def bucket_histograms(spark, sf):
    """O-63, O-124: independent histograms in one pass."""
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", exprs.people_bucket(F.col("o_custkey") % 40).alias("bucket"))
    a, b, c = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("bucket")
    return df.groupingSets([[a], [b], [c]], a, b, c).agg(F.count("*").alias("n"), F.grouping_id(a, b, c).alias("g"))


@query("""
    SELECT o_orderkey, (SELECT a FROM (VALUES (0, 1995), (1, 1997), (2, 1999), (3, 2002)) v(i, a) ORDER BY abs(y - a), i LIMIT 1)::INTEGER AS anchor
    FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)
""")
def nearest_anchor(spark, sf):
    """O-56h: as-of join to a few anchors."""
    df = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return rel.nearest_anchor(df, F.col("y"), [1995, 1997, 1999, 2002]).select("o_orderkey", "anchor")


@query("""
    WITH d AS (SELECT p_brand, p_type, min(p_partkey) AS r FROM part GROUP BY ALL)
    SELECT b.p_brand, b.size_sum, b.best, b.first_type, string_agg(d.p_type, '|' ORDER BY d.r) AS types
    FROM (SELECT p_brand, sum(p_size)::BIGINT AS size_sum, min(p_partkey) AS best, arg_min(p_type, p_partkey) AS first_type FROM part GROUP BY 1) b JOIN d USING (p_brand)
    GROUP BY ALL
""")
def brand_aggregate(spark, sf):
    """O-59: sum, min, ordered distinct concatenation, first by rank."""
    part = table(spark, sf, "part")
    kinds = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("r"), F.sum("p_size").alias("s"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "p_type"))), lambda x: x["p_type"]), "|")
    return kinds.groupBy("p_brand").agg(F.sum("s").alias("size_sum"), F.min("r").alias("best"), F.min_by("p_type", "r").alias("first_type"), ordered.alias("types"))


@query("""
    SELECT p_partkey, p_brand, sum(p_size) OVER w::BIGINT AS brand_size, min(p_partkey) OVER w AS best, round(greatest(1, pow(sum(p_size) OVER w, 0.75)), 6) AS weight
    FROM part WINDOW w AS (PARTITION BY p_brand)
""")
def detail_with_group(spark, sf):
    """O-188, O-126: each row with its group's aggregate and 0.75-power weight, by aggregate and broadcastable join."""
    part = table(spark, sf, "part")
    sums = part.groupBy("p_brand").agg(F.sum("p_size").alias("brand_size"), F.min("p_partkey").alias("best"))
    return part.select("p_partkey", "p_brand").join(sums, "p_brand").withColumn("weight", F.round(F.greatest(F.lit(1.0), F.pow("brand_size", F.lit(0.75))), 6))


@query("SELECT p_brand, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY 1")
def group_bounds(spark, sf):
    """O-189."""
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


# Step 2: completeness, keys, windows


@query("""
    SELECT o.o_orderkey, (1 + o.o_orderkey % 6)::BIGINT AS expected, coalesce(n, 0) AS observed
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey WHERE coalesce(n, 0) <> 1 + o.o_orderkey % 6
""")
def expected_vs_observed(spark, sf):
    """O-61."""
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 6 + 1).alias("expected")).join(counts, "o_orderkey", "left")
    return joined.select("o_orderkey", "expected", F.coalesce("n", F.lit(0)).alias("observed")).where("observed <> expected")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """O-62."""
    return rel.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_children(spark, sf):
    """O-57."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
    WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
    SELECT l_orderkey, 'missing' AS side FROM r WHERE l_orderkey NOT IN (FROM a) UNION ALL SELECT l_orderkey, 'unexpected' FROM a WHERE l_orderkey NOT IN (FROM r)
""")
def set_difference_two_way(spark, sf):
    """O-99."""
    items = table(spark, sf, "lineitem")
    return rel.two_way_difference(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'"), "l_orderkey")


@query("SELECT user_id, count(DISTINCT event_type) AS n_event_type, count(DISTINCT props) AS n_props FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1 OR count(DISTINCT props) > 1")
def attribute_conflicts(spark, sf):
    """O-75."""
    return rel.conflicts(table(spark, sf, "events"), "user_id", "event_type", "props")


@query("""
    WITH b AS (SELECT user_id, event_id, ts, floor(value) AS x FROM events),
    n AS (SELECT *, lead(x) OVER w AS x2, lead(event_id) OVER w AS next_id FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, next_id FROM n WHERE least(x + 10, x2 + 10) - greatest(x, x2) > 0.5
""")
def adjacent_overlap(spark, sf):
    """O-82: neighbouring boxes that overlap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.floor("value").cast("double")
    boxed = table(spark, sf, "events").select("user_id", "event_id", "ts", F.array(x, F.lit(0.0), x + 10, F.lit(5.0)).alias("box"))
    paired = boxed.withColumns({"after": F.lead("box").over(w), "next_id": F.lead("event_id").over(w)})
    return paired.where(exprs.positive_overlap(F.col("box"), F.col("after"))).select("user_id", "event_id", "next_id")


_RUNS = """
    WITH p AS (SELECT user_id, event_type, row_number() OVER w AS pos, coalesce((event_type IS DISTINCT FROM lag(event_type) OVER w)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN pos = 1 THEN 1 ELSE new END) OVER (PARTITION BY user_id ORDER BY pos)::BIGINT AS run FROM p)
"""


@query(_RUNS + "SELECT user_id, run, first(event_type) AS event_type, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos, count(*) AS length FROM r GROUP BY user_id, run")
def consecutive_runs(spark, sf):
    """O-83."""
    return rel.runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query(_RUNS + "SELECT user_id, event_type, count(DISTINCT run) AS islands FROM r GROUP BY ALL HAVING count(DISTINCT run) > 1")
def contiguity_guard(spark, sf):
    """O-86: values that reappear after another began."""
    spans = rel.runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return spans.groupBy("user_id", "event_type").agg(F.count("*").alias("islands")).where("islands > 1")


@query("""
    SELECT l_suppkey, l_orderkey, n, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
""")
def prefix_offsets(spark, sf):
    """O-87."""
    groups = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"))
    before = Window.partitionBy("l_suppkey").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("""
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::INTEGER AS in_group,
        (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS in_image FROM d
""")
def double_positions(spark, sf):
    """O-80, O-81."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    a = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    b = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumns({"in_group": F.row_number().over(a) - 1, "in_image": F.row_number().over(b) - 1})


@query("SELECT o_orderkey, (o_orderkey // 100 + 1)::BIGINT AS volume, (o_orderkey % 100 + 1)::BIGINT AS page, printf('%s_%05d-%05d', 'base', o_orderkey // 25 * 25 + 1, o_orderkey // 25 * 25 + 25) AS chunk FROM orders")
def volume_pagination(spark, sf):
    """O-44, O-111, O-182."""
    k = F.col("o_orderkey")
    start = F.floor(k / 25) * 25 + 1
    return table(spark, sf, "orders").select("o_orderkey", (F.floor(k / 100) + 1).alias("volume"), (k % 100 + 1).alias("page"), F.format_string("%s_%05d-%05d", F.lit("base"), start, start + 24).alias("chunk"))


# Step 3: metrics


def _cells(spark, sf) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "lineitem")
    last = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    one = items.groupBy("l_orderkey", "l_linenumber").agg(F.max(last).alias("x"))
    text = F.concat("x.l_returnflag", "x.l_linestatus", F.col("x.l_partkey").cast("string"))
    cells = one.select((F.col("l_orderkey") % 500).alias("schedule_id"), F.col("l_orderkey").alias("row_index"), F.col("l_linenumber").alias("day"), text.alias("text"))
    luck = exprs.hex_prefix(F.concat_ws(":", F.lit("3"), F.col("row_index").cast("string"), F.col("day").cast("string")), 8) % 100
    truth = cells.withColumn("ignore", luck == 99)
    found = cells.withColumn("luck", luck).where("luck >= 3").withColumn("text", F.when(F.col("luck") < 10, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return truth, found.select("schedule_id", "row_index", (F.col("day") + F.when(F.col("luck") == 50, 100).otherwise(0)).alias("day"), "text")


@query("""
    WITH o AS (SELECT l_orderkey, l_linenumber, max({'a': l_partkey, 'b': l_suppkey, 'c': l_quantity, 'd': l_extendedprice, 'e': l_returnflag, 'f': l_linestatus}) AS x FROM lineitem GROUP BY 1, 2),
    c AS (SELECT l_orderkey % 500 AS s, l_orderkey AS r, l_linenumber AS d, x.e || x.f || x.a AS txt, ('0x' || substr(sha256('3:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT % 100 AS luck FROM o),
    t AS (SELECT s, r, d, txt FROM c WHERE luck <> 99),
    p AS (SELECT s, r, d + CASE WHEN luck = 50 THEN 100 ELSE 0 END AS d, CASE WHEN luck < 10 THEN 'x' || txt ELSE txt END AS f FROM c WHERE luck >= 3),
    j AS (SELECT * FROM t FULL JOIN p USING (s, r, d)),
    e AS (SELECT s, r, coalesce(txt = f, false) AS ok, levenshtein(txt, coalesce(f, '')) AS edits, length(txt) AS chars FROM j WHERE txt IS NOT NULL),
    rr AS (SELECT s, r, bool_and(ok) AS row_ok FROM e GROUP BY ALL), ss AS (SELECT s, bool_and(row_ok) AS all_ok FROM rr GROUP BY ALL)
    SELECT (SELECT count(*) FROM e) AS cells, (SELECT round(count_if(ok) / greatest(1, count(*)), 9) FROM e) AS cell_exact, (SELECT round(sum(edits) / greatest(1, sum(chars)), 9) FROM e) AS cer,
        (SELECT round(count_if(row_ok) / greatest(1, count(*)), 9) FROM rr) AS row_accuracy, (SELECT round(count_if(all_ok) / greatest(1, count(*)), 9) FROM ss) AS schedule_accuracy, (SELECT count(*) FROM j WHERE txt IS NULL) AS false_positives
""")
def cell_evaluation(spark, sf):
    """O-67 (O-56e, O-50, O-58, O-66, O-68): the flagship."""
    return rel.evaluate_cells(*_cells(spark, sf))


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS edits FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance_pairs(spark, sf):
    """O-106 on ASCII names."""
    part = table(spark, sf, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("bigint").alias("edits"))


@query("""
    WITH a AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, max(value) AS top, count_if(value < 10) AS low FROM events GROUP BY 1)
    SELECT event_type, v[round_even((n - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((n - 1) * 0.95, 0)::INT + 1] AS p95, top, round(low / greatest(1, n), 9) AS low_rate FROM a
""")
def rank_percentiles(spark, sf):
    """O-69, O-71: nearest-rank percentiles by row number, no gathered groups."""
    events = table(spark, sf, "events").select("event_type", "value")
    sizes = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.count_if(F.col("value") < 10).alias("low"))
    ranked = events.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy("value"))).join(sizes, "event_type")
    at = lambda share: F.max(F.when(F.col("rn") == exprs.half_even((F.col("n") - 1) * share) + 1, F.col("value")))
    return ranked.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.first("top").alias("top"), F.first(F.round(F.col("low") / F.greatest(F.lit(1), F.col("n")), 9)).alias("low_rate"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS middle FROM events GROUP BY 1")
def interp_percentiles(spark, sf):
    """O-70, O-72."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.9), 6).alias("p90"), F.round(F.median("value"), 6).alias("middle"))


@query("SELECT event_type, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS mean FROM events GROUP BY 1")
def weighted_mean(spark, sf):
    """O-73."""
    w = 1 + F.col("user_id") % 3
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * w) / F.sum(w), 6).alias("mean"))


@query("SELECT l_returnflag, coalesce(avg(n), 0.0) AS mean_n, coalesce(max(n), 0) AS max_n, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def group_sizes(spark, sf):
    """O-64."""
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_returnflag").agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_n"), F.coalesce(F.max("n"), F.lit(0)).alias("max_n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


_ROUTES = "SELECT chr(65 + (s_suppkey % 4)::INT) AS route, 0.9 + avg(s_suppkey % 7) / 1000 AS accuracy, max(s_suppkey % 97)::DOUBLE - 30 * (s_suppkey % 4) AS p95, min(s_suppkey)::DOUBLE AS mem FROM supplier GROUP BY s_suppkey % 4"


@query(f"""
    WITH r AS ({_ROUTES}), d AS (SELECT accuracy AS a0, p95 AS p0, mem AS m0 FROM r WHERE route = 'D'),
    fit AS (SELECT route FROM r, d WHERE route IN ('A', 'C') AND a0 - accuracy <= 0.005 AND greatest(1 - p95 / greatest(1e-9, p0), 1 - mem / greatest(1e-9, m0)) >= 0.15 ORDER BY p95, mem, route LIMIT 1),
    best AS (SELECT route FROM r ORDER BY accuracy DESC, p95, mem, route LIMIT 1)
    SELECT coalesce((SELECT route FROM fit), (SELECT route FROM best)) AS route
""")
def guarded_selection(spark, sf):
    """O-94 on figures derived from suppliers."""
    k = F.col("s_suppkey")
    figures = table(spark, sf, "supplier").groupBy((k % 4).alias("m")).agg((0.9 + F.avg(k % 7) / 1000).alias("accuracy"), F.max(k % 97).cast("double").alias("p"), F.min(k).cast("double").alias("mem"))
    return rel.choose_route(figures.select(F.chr(65 + F.col("m")).alias("route"), F.lit("validation").alias("split"), "accuracy", (F.col("p") - 30 * F.col("m")).alias("p95"), "mem"))


@query("""
    SELECT arg_min(s_name, {'a': s_suppkey % 13, 'b': s_nationkey, 'c': s_suppkey % 5, 'd': s_name}) AS profile FROM supplier WHERE CASE WHEN s_suppkey % 11 = 0 THEN 1.0 ELSE (s_suppkey % 10) / 1000.0 END <= 0.005
""")
def profile_selection(spark, sf):
    """O-95."""
    k = F.col("s_suppkey")
    loss = F.when(k % 11 != 0, (k % 10) / 1000.0)
    return rel.choose_profile(table(spark, sf, "supplier").select(F.col("s_name").alias("profile"), F.lit(True).alias("usable"), loss.alias("accuracy_loss"), (k % 13).alias("p95"), F.col("s_nationkey").alias("mem"), (k % 5).alias("size")))


@query("""
    WITH v AS (SELECT c_nationkey, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1), p AS (SELECT list(a ORDER BY c_nationkey) AS v, count(*) AS n FROM v),
    m AS (SELECT r, round(list_sum(list_transform(range(n), lambda i: v[(('0x' || substr(sha256('20260723:' || r || ':' || i), 1, 8))::BIGINT % n) + 1])) / n, 9) AS m FROM p, range(2000) t(r)),
    s AS (SELECT list_sort(list(m)) AS m FROM m)
    SELECT round(avg(a), 6) AS mean, round((SELECT m[49 + 1] FROM s), 6) AS low, round((SELECT m[1950 + 1] FROM s), 6) AS high FROM v
""")
def bootstrap_ci(spark, sf):
    """O-79 over nations' mean balances."""
    values = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("a"))
    return rel.bootstrap_interval(values, "a", "c_nationkey").select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query("SELECT count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) AS equivalent FROM (SELECT DISTINCT label AS a, label * 3 + 1 AS b FROM embeddings)")
def partition_equivalence(spark, sf):
    """O-156."""
    return rel.partition_equivalent(table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("label") * 3 + 1).alias("b")), "a", "b")


@query("""
    WITH RECURSIVE e AS (SELECT c_nationkey AS p, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS e, c_custkey % 7 AS m, c_custkey % 3 AS t FROM customer),
    f AS (SELECT p, e, m, t FROM e WHERE e = 1 UNION ALL
          SELECT f.p, x.e, CASE WHEN w THEN x.m ELSE f.m END, CASE WHEN w THEN x.t ELSE f.t END FROM (SELECT f.p, f.e, f.m, f.t FROM f) f JOIN (SELECT p, e, m, t FROM e) x ON x.p = f.p AND x.e = f.e + 1, LATERAL (SELECT x.m > f.m OR (x.m = f.m AND x.t < f.t) AS w))
    SELECT p AS c_nationkey, arg_max(m, e)::DOUBLE AS metric FROM f GROUP BY 1
""")
def best_checkpoint(spark, sf):
    """O-96: running best with a tie-breaker."""
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("e"), (F.col("c_custkey") % 7).cast("double").alias("m"), (F.col("c_custkey") % 3).cast("double").alias("t"))
    return rel.running_best(c, "c_nationkey", "e", "m", "t").select("c_nationkey", "metric")


# Step 4: text, geometry, dates


@query("""
    WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
    SELECT ch, count(*) AS n, regexp_full_match(ch, '[A-Za-z ]') AS in_charset FROM c WHERE ch <> '' GROUP BY 1
""")
def char_coverage(spark, sf):
    """O-65: partial counts per task, so the hot characters don't travel row by row."""
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), 32)]
    charset = spark.createDataFrame([(c,) for c in letters], "ch string")
    return rel.char_coverage(table(spark, sf, "documents").select("text"), F.col("text"), charset)


@query("SELECT doc_id, nfc_normalize(text) = text AS is_nfc, length(nfc_normalize(text || 'e' || chr(769)))::INTEGER AS n FROM documents")
def nfc_report(spark, sf):
    """O-104: normal form, and the length with a decomposed letter added."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", (udfs.nfc("text") == F.col("text")).alias("is_nfc"), F.length(udfs.nfc(F.concat("text", F.lit("é")))).alias("n"))


@query("""
    WITH d(code, ord) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('2-High', 3), ('F', 4), ('f', 5)),
    s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE ' ' || o_orderpriority END AS t FROM orders)
    SELECT o_orderkey, coalesce((SELECT code FROM d WHERE code = trim(t)), (SELECT arg_max(code, ord) FROM d WHERE lower(code) = lower(trim(t)))) AS canonical FROM s
""")
def canonicalize_codes(spark, sf):
    """O-105, O-10."""
    codes = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("2-High", 3), ("F", 4), ("f", 5)], "code string, ord int")
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("t"))
    return rel.canonicalise(orders, "t", codes).select("o_orderkey", "canonical")


_LIMB = "('0x' || substr(h, {}, 8))::BIGINT"


@query("WITH s AS (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS h FROM orders) SELECT count(*) AS n, " + ", ".join(f"bit_xor({_LIMB.format(8 * i + 1)}) AS x{i}, sum({_LIMB.format(8 * i + 1)})::BIGINT AS s{i}" for i in range(8)) + " FROM s")
def multiset_checksum(spark, sf):
    """O-74."""
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return rel.checksum_limbs(table(spark, sf, "orders"), text)


def _quads(spark, sf) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    x, y = (k % 900).cast("double"), (n * 40 + F.col("l_partkey") % 17).cast("double")
    w, h = F.col("l_quantity") * 8 + 1, 20.0 + (k % 5).cast("double")
    quad = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", quad.alias("quad")).distinct()


_QUAD_SQL = """
    WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (l_orderkey % 900)::DOUBLE AS x, (l_linenumber * 40 + l_partkey % 17)::DOUBLE AS y, l_quantity * 8 + 1 AS w, 20.0::DOUBLE + l_orderkey % 5 AS h FROM lineitem)
"""


@query(_QUAD_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(w * h, 6) AS area, true AS convex, x + w <= 1000 AND y + h <= 300 AS inside, CASE WHEN x + w > 1001 OR y + h > 301 THEN 'outside_image' END AS reason, x AS x0, y + h AS y1 FROM q")
def polygon_metrics(spark, sf):
    """O-128 to O-130, O-132, O-133."""
    q, w, h = F.col("quad"), F.lit(1000.0), F.lit(300.0)
    box = exprs.bounding_box(q)
    return _quads(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(exprs.polygon_area(q), 6).alias("area"), exprs.is_convex_quad(q).alias("convex"), exprs.inside_image(q, w, h).alias("inside"), exprs.quad_reason(q, w, h).alias("reason"), box[0].alias("x0"), box[3].alias("y1"))


@query(_QUAD_SQL + ", s AS (SELECT *, greatest(least(round_even(48 * w / h, 0)::BIGINT, 640), 8) AS width FROM q) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, width, CASE WHEN width <= 160 THEN 160 WHEN width <= 320 THEN 320 ELSE 640 END::INTEGER AS bucket FROM s")
def width_buckets(spark, sf):
    """O-125."""
    sized = _quads(spark, sf).withColumn("width", exprs.quad_width(F.col("quad")).cast("bigint"))
    return sized.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "width", exprs.width_bucket(F.col("width")).alias("bucket"))


@query(_QUAD_SQL + """, v AS (SELECT *, greatest(least(x + w, 1000) - x, 0) * greatest(least(y + h, 300) - y, 0) / (w * h) AS seen FROM q)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(seen, 6) AS visibility, seen < 0.6 AS ignore FROM v WHERE seen >= 0.2""")
def visibility_filter(spark, sf):
    """O-51, O-135: boxes less than a fifth visible go, those under three fifths are ignored."""
    seen = _quads(spark, sf).withColumn("seen", exprs.visible_share(exprs.bounding_box(F.col("quad")), F.lit(1000.0), F.lit(300.0)))
    return seen.where("seen >= 0.2").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round("seen", 6).alias("visibility"), (F.col("seen") < 0.6).alias("ignore"))


@query("""
    SELECT DISTINCT y, m, d::BIGINT AS d, strftime(make_date(y, m, d), '%Y-%m-%d') AS iso, (['Mo','Tu','We','Th','Fr','Sa','Su'])[isodow(make_date(y, m, d))] AS day_name
    FROM (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), LATERAL (SELECT unnest(range(1, 1 + day(last_day(make_date(y, m, 1))))) AS d)
""")
def calendar_expand(spark, sf):
    """O-121 to O-123, O-34."""
    months = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    first = F.make_date("y", "m", F.lit(1))
    days = months.select("y", "m", F.explode(F.sequence(F.lit(1), F.day(F.last_day(first)))).alias("d")).withColumn("date", F.make_date("y", "m", "d"))
    names = F.array(*(F.lit(x) for x in ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")))
    return days.select("y", "m", F.col("d").cast("bigint").alias("d"), F.date_format("date", "yyyy-MM-dd").alias("iso"), F.get(names, F.weekday("date")).alias("day_name"))


@query("SELECT user_id, count_if(event_type = 'click') AS clicks, count_if(upper(event_type) IN ('VIEW', 'PURCHASE')) AS views, count(*) AS n FROM events GROUP BY 1")
def row_summary_counts(spark, sf):
    """O-77: conditional counts, case-sensitive and not, in one aggregate."""
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(F.upper(kind).isin("VIEW", "PURCHASE")).alias("views"), F.count("*").alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"k\":' || (props->>'$.k') || '}' AS again FROM events")
def json_roundtrip(spark, sf):
    """O-41."""
    parsed = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return parsed.select("event_id", "p.k", F.to_json("p").alias("again"))


@query("""
    WITH RECURSIVE l AS (SELECT p_partkey, p_partkey AS n, '' AS s FROM part UNION ALL SELECT p_partkey, (n - 1) // 26, chr(65 + ((n - 1) % 26)::INT) || s FROM l WHERE n > 0)
    SELECT p_partkey, s AS letters FROM l WHERE n = 0
""")
def column_letters(spark, sf):
    """O-37."""
    return table(spark, sf, "part").select("p_partkey", exprs.column_letters(F.col("p_partkey")).alias("letters"))


@query("SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_brand, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) % 12 AS colour FROM part")
def palette_index(spark, sf):
    """O-120."""
    return table(spark, sf, "part").select("p_partkey", exprs.polynomial_hash(F.col("p_brand"), 12).alias("colour"))


@query("SELECT p_partkey, least((p_partkey % 30) // greatest(5, round_even(30 / 3.0, 0))::BIGINT + 1, 3)::INTEGER AS grp, (p_partkey % 6 + 1)::BIGINT AS team, CASE WHEN p_size <= 10 THEN 'small' ELSE p_type END AS title, regexp_matches(p_brand, '[A-Za-z]') AS has_letter FROM part")
def derived_labels(spark, sf):
    """O-36, O-39, O-108, and O-43 in part."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", exprs.group_label(k % 30, F.lit(30)).alias("grp"), (k % 6 + 1).alias("team"), F.when(F.col("p_size") <= 10, "small").otherwise(F.col("p_type")).alias("title"), F.col("p_brand").rlike("[A-Za-z]").alias("has_letter"))


@query("SELECT label, count(*) AS n, round(min(list_min(embedding)), 6) AS low, round(max(list_max(embedding)), 6) AS high FROM embeddings GROUP BY 1")
def embedding_bounds(spark, sf):
    """Least and greatest components of an array column."""
    e = table(spark, sf, "embeddings").select("label", F.array_min("embedding").cast("double").alias("a"), F.array_max("embedding").cast("double").alias("b"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("a"), 6).alias("low"), F.round(F.max("b"), 6).alias("high"))


# Step 5: splits, packing, sampling


@query()
def hamilton_split(spark, sf):
    """O-150, O-151: tested by its invariants."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.month("o_orderdate").alias("month"))
    return rel.stratified_split(orders, "o_orderkey", ["o_orderpriority", "month"], 7)


@query("""
    WITH RECURSIVE c AS (SELECT o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY k) AS i, k, n FROM (SELECT o_orderstatus, o_custkey AS k, count(*) AS n FROM orders GROUP BY 1, 2)),
    f AS (SELECT split, i, k, n, 0 AS shard, 1 AS g, n AS r FROM c WHERE i = 1 UNION ALL
          SELECT c.split, c.i, c.k, c.n, f.shard + (f.g >= 40 OR f.r + c.n > 120)::INT, CASE WHEN f.g >= 40 OR f.r + c.n > 120 THEN 1 ELSE f.g + 1 END, CASE WHEN f.g >= 40 OR f.r + c.n > 120 THEN c.n ELSE f.r + c.n END
          FROM f JOIN c ON c.split = f.split AND c.i = f.i + 1)
    SELECT split, k AS schedule_id, n, shard FROM f
""")
def shard_packing(spark, sf):
    """O-60."""
    sizes = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("schedule_id")).agg(F.count("*").alias("n"))
    return rel.pack_shards(sizes, 40, 120)


@query("""
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
    u AS (SELECT *, greatest(('0x' || substr(sha256('9:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 12))::BIGINT::DOUBLE / 281474976710656.0, pow(2, -49)) AS u FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY -ln(u) / CASE WHEN l_partkey % 10 = 0 THEN 3.0 ELSE 1.0 END, l_orderkey, l_linenumber, l_partkey, l_suppkey)::INTEGER AS draw_rank FROM u)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, draw_rank FROM r WHERE draw_rank <= 128
""")
def weighted_sample_cap(spark, sf):
    """O-164: rare classes weigh 3 to 1, 128 a group (a sampling operator, so the cap is the feature)."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rel.capped_weighted_sample(rows, 9, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_suppkey", F.when(F.col("l_partkey") % 10 == 0, 3.0).otherwise(1.0), 128)


@query("""
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
    SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 16 AS batch FROM d
""")
def batch_assignment(spark, sf):
    """O-165, O-166."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rel.batches(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 16)


@query("SELECT o_orderkey, u, CASE WHEN u < 0.6 THEN 'ground_truth' WHEN u < 0.9 THEN 'jitter' ELSE 'predicted' END AS mode FROM (SELECT o_orderkey, ('0x' || substr(sha256('13:' || o_orderkey), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM orders)")
def crop_modes(spark, sf):
    """O-167."""
    return table(spark, sf, "orders").select("o_orderkey", exprs.uniform(13, F.col("o_orderkey")).alias("u")).withColumn("mode", F.when(F.col("u") < 0.6, "ground_truth").when(F.col("u") < 0.9, "jitter").otherwise("predicted"))


@query("""
    WITH w AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey)::DOUBLE AS hi, p_size::DOUBLE AS s, (SELECT sum(p_size) FROM part)::DOUBLE AS total FROM part),
    d AS (SELECT c_custkey, ('0x' || substr(sha256('21:' || c_custkey), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u FROM customer)
    SELECT c_custkey, (SELECT arg_min(p_partkey, hi) FROM w WHERE hi > u * total) AS p_partkey FROM d
""")
def weighted_pick(spark, sf):
    """O-160: weighted draw with replacement."""
    draws = table(spark, sf, "customer").select("c_custkey", exprs.uniform(21, F.col("c_custkey")).alias("u"))
    return rel.weighted_picks(draws, F.col("u"), table(spark, sf, "part"), "p_partkey", "p_size").select("c_custkey", "p_partkey")


# Step 6: grouped algorithms on derived boxes


def _boxes(spark, sf) -> DataFrame:
    k = F.col("event_id")
    jitter = lambda name: exprs.uniform(name, k) * 6
    x, y = (k % 20) * 50.0 + jitter("x"), (F.floor(k / 20) % 10) * 30.0 + jitter("y")
    return table(spark, sf, "events").select(F.floor(k / 200).alias("image"), F.col("event_id"), F.array(x, y, x + 40, y + 18).alias("box"))


@query()
def row_clusters(spark, sf):
    """O-153."""
    return grouped.cluster_rows(_boxes(spark, sf), "image", "event_id", "box")


@query()
def topology_bands(spark, sf):
    """O-152: vertical bands of each image's boxes."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("event_id")
        return pd.DataFrame({"image": group["image"], "event_id": group["event_id"], "band": grouped.topology_bands([(b[1], b[3]) for b in group["box"]])})

    return _boxes(spark, sf).groupBy("image").applyInPandas(run, "image long, event_id long, band long")


@query()
def header_alignment(spark, sf):
    """O-154: the first row of each image holds day numbers, the first column names."""
    import pandas as pd

    texted = _boxes(spark, sf).withColumn("text", F.when(F.floor(F.col("event_id") / 20) % 10 == 0, (F.col("event_id") % 20).cast("string")).otherwise(F.concat(F.lit("c"), F.col("event_id").cast("string"))))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("event_id")
        cells, _ = grouped.align_headers(list(zip(group["text"], (tuple(b) for b in group["box"]), strict=True)))
        return pd.DataFrame([(group["image"].iloc[0], *c) for c in cells], columns=["image", "row_no", "day", "text", "kind"])

    return texted.groupBy("image").applyInPandas(run, "image long, row_no long, day long, text string, kind string")


@query()
def greedy_iou_match(spark, sf):
    """O-56j, O-157."""
    quad = lambda b: F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))
    boxes = _boxes(spark, sf)
    shift = exprs.uniform("s", F.col("event_id")) * 30
    moved = boxes.select("image", "event_id", F.transform("box", lambda v, i: F.when(i % 2 == 0, v + shift).otherwise(v)).alias("box"))
    as_quads = lambda df: df.select("image", "event_id", quad(F.col("box")).alias("quad"))
    return grouped.match_quads(as_quads(moved), as_quads(boxes), "image", "event_id", "quad")


@query()
def embedding_components(spark, sf):
    """O-155: single linkage within images of bounded size."""
    images = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("image"), "vec_id", "embedding")
    return grouped.cluster_embeddings(images, "image", "vec_id", "embedding", 1.0)


@query(r"""
    WITH f AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2))) AS x FROM pages),
    n AS (SELECT page_id, x[1] AS target, x[2] AS label, row_number() OVER (PARTITION BY page_id) AS i FROM f)
    SELECT page_id, target, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target, label) AS k FROM n) WHERE k = 1
""")
def html_rank_extract(spark, sf):
    """O-11, O-12 in part: entries of a page's list, each once."""
    pattern = F.lit(r'<a href="/([^"]*)">([^<]*)</a>')
    zipped = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("target"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    return table(spark, sf, "pages").select("page_id", F.explode(zipped).alias("x")).select("page_id", "x.target", "x.label").distinct()


# Step 7: reports


@query("""
    SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_orders,
        (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_cells,
        (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS empty_orders,
        (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unknown_orders,
        (SELECT count(*) FROM documents WHERE n_chars <> length(text)) AS wrong_lengths
""")
def qa_report(spark, sf):
    """O-168, O-169: one row of failed-check counts."""
    orders, items, docs = (table(spark, sf, t) for t in ("orders", "lineitem", "documents"))
    keys = items.select(F.col("l_orderkey").alias("o_orderkey"))
    counts = {
        "duplicate_orders": rel.duplicates(orders, "o_orderkey"), "duplicate_cells": rel.duplicates(items, "l_orderkey", "l_linenumber"),
        "empty_orders": orders.join(keys, "o_orderkey", "left_anti"), "unknown_orders": keys.join(orders, "o_orderkey", "left_anti"),
        "wrong_lengths": docs.where(F.col("n_chars") != F.length("text")),
    }
    out = None
    for name, failed in counts.items():
        one = failed.agg(F.count("*").alias(name))
        out = one if out is None else out.join(one)  # single rows
    return out


@query("""
    SELECT s.split, coalesce(n, 0) AS n FROM (VALUES ('train'), ('validation'), ('test'), ('ood_layout')) s(split)
    LEFT JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1) USING (split)
""")
def split_counts(spark, sf):
    """O-76: zero counts included."""
    names = spark.createDataFrame([(s,) for s in ("train", "validation", "test", "ood_layout")], "split string")
    status = F.col("o_orderstatus")
    counts = table(spark, sf, "orders").groupBy(F.when(status == "F", "train").when(status == "O", "validation").otherwise("test").alias("split")).agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 5")
def top_balances(spark, sf):
    """O-91, O-97: bounded report, first five a nation in mixed order (a top-k)."""
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal").withColumn("k", F.row_number().over(order)).where("k <= 5").drop("k")


@query("SELECT a.o_orderkey, a.o_custkey, b.c_mktsegment, coalesce(b.c_acctbal, 0.0) AS balance FROM orders a LEFT JOIN (FROM customer WHERE c_custkey % 4 <> 0) b ON a.o_custkey = b.c_custkey")
def optional_enrichment(spark, sf):
    """O-35, O-56b, O-56c."""
    known = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left").select("o_orderkey", "o_custkey", "c_mktsegment", F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      floor(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) * 1.25 + 0.5)::BIGINT AS edge FROM lineitem
""")
def pixel_edges(spark, sf):
    """O-45: running widths scaled to pixels, halves rounded up."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.floor(F.sum("l_quantity").over(order) * F.lit(1.25) + F.lit(0.5)).cast("bigint")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", edge.alias("edge"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND (CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END) IS DISTINCT FROM false")
def not_explicitly_false(spark, sf):
    """O-53, O-54: kinds in a list; only an explicit false is dropped."""
    flag = F.when(F.col("o_custkey") % 3 == 1, False).when(F.col("o_custkey") % 3 == 2, True)
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P") & ~flag.eqNullSafe(F.lit(False))).select("o_orderkey")


@query("""
    SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::BIGINT % 3 = 1 THEN 'validation' ELSE 'train' END AS role
    FROM orders WHERE o_orderstatus = 'F'
""")
def cv_partition(spark, sf):
    """O-55."""
    train = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.lit("train").alias("split"))
    return rel.cv_partition(train, exprs.cv_fold(7, F.col("o_orderkey")), 1).select("o_orderkey", "role")


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type) AS place FROM events GROUP BY user_id, event_type")
def ordered_distinct(spark, sf):
    """O-98."""
    return rel.ordered_distinct(table(spark, sf, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "place")


@query("SELECT o_orderkey // 4 AS batch, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 1")
def mixed_batches(spark, sf):
    """O-177."""
    return rel.mixed_groups(table(spark, sf, "orders"), F.expr("o_orderkey div 4"), "o_orderstatus")


@query("""
    SELECT c_custkey, coalesce(stated, c_mktsegment) AS c_mktsegment, coalesce(stated <> c_mktsegment, false) AS conflict
    FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 1 THEN c_mktsegment WHEN 2 THEN 'BUILDING' END AS stated FROM customer)
""")
def filled_with_conflicts(spark, sf):
    """O-149."""
    customer, k = table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") % 3
    stated = customer.select("c_custkey", F.when(k == 1, F.col("c_mktsegment")).when(k == 2, "BUILDING").alias("c_mktsegment"))
    return rel.filled_from(stated, customer, "c_custkey", "c_mktsegment")


@query("""
    WITH p AS (SELECT c_custkey AS id, 'plan_' || CASE WHEN c_custkey < 10000 THEN lpad(c_custkey::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END AS schedule_id FROM customer WHERE c_custkey > 0),
    s AS (SELECT *, ('0x' || substr(sha256('11:' || schedule_id), 1, 15))::BIGINT AS seed, (['A', 'B', 'C'])[(id - 1) % 3 + 1] AS template_id FROM p)
    SELECT *, (1 + ('0x' || substr(sha256(seed || ':month'), 1, 8))::BIGINT % 12)::INTEGER AS month, (18 + ('0x' || substr(sha256(seed || ':people_count'), 1, 8))::BIGINT % 15)::INTEGER AS people_count FROM s
""")
def dataset_plan(spark, sf):
    """O-163, O-185: templates in turn; month and people count are hashed draws."""
    ids = table(spark, sf, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("id"))
    return rel.dataset_plan(ids, 11, ["A", "B", "C"], "plan")


# Step 8: extensions beyond the reference


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf):
    """Extension: tumbling windows over events; streaming.events has the streamed form."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    WITH g AS (SELECT user_id, ts, event_id, (ts - lag(ts) OVER w > INTERVAL 12 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, sum(coalesce(new, 1)) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)
    SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2
""")
def user_sessions(spark, sf):
    """Extension: sessions parted by twelve idle hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("interval 12 hours")).cast("int"), F.lit(1))
    marked = table(spark, sf, "events").select("user_id", "ts", "event_id").withColumn("new", gap)
    return marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))
