"""Operators that SQL can't express, guards and sources, on small inputs."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import exprs, udfs
from quillspark.operators import grouped
from quillspark.operators import relational as rel
from quillspark.operators.components import connected_components
from quillspark.sources import io
from quillspark.streaming import events as stream


def test_components_on_chains_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (None, 3)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_split_invariants(spark):
    df = spark.createDataFrame([(f"s{i}", f"t{i % 5}", i % 12 + 1 if i % 9 else None) for i in range(600)], "schedule_id string, template string, month int")
    rows = rel.stratified_split(df, "schedule_id", ["template", "month"], 7).collect()
    totals = Counter(r["split"] for r in rows)
    assert (totals["train"], totals["validation"], totals["test"]) == (420, 90, 90)
    assert all((r["cv_fold"] in (0, 1, 2)) == (r["split"] == "train") for r in rows)
    by = Counter((r["template"], r["month"]) for r in rows)
    for (t, m), n in by.items():
        for s, ratio in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
            k = sum(r["split"] == s for r in rows if (r["template"], r["month"]) == (t, m))
            assert int(ratio * n) <= k <= int(ratio * n) + 2


def test_authorisation(spark):
    split = spark.createDataFrame([("a", "train", 0), ("b", "validation", -1)], "schedule_id string, split string, cv_fold int")
    records = spark.createDataFrame([("a",), ("b",)], "schedule_id string")
    assert [r["schedule_id"] for r in rel.for_purpose(records, split, "cv").collect()] == ["a"]
    assert [r["schedule_id"] for r in rel.for_purpose(records, split, "route").collect()] == ["b"]
    assert rel.authorised(records, split, "test").count() == 2
    assert rel.authorised(records.where("schedule_id = 'a'"), split, "train").count() == 1
    for purpose in ("train", "cv", "route"):
        with pytest.raises(Exception, match="not allowed for"):
            rel.authorised(records, split, purpose).collect()
    with pytest.raises(Exception, match="invalid fold"):
        rel.authorised(records.limit(1), spark.createDataFrame([("a", "train", 7)], split.schema), "cv").collect()
    with pytest.raises(Exception, match="unknown schedule_id"):
        rel.authorised(spark.createDataFrame([("zz",)], "schedule_id string"), split, "test").collect()
    stated = spark.createDataFrame([("a", "train"), ("b", None)], "schedule_id string, stated string")
    assert rel.authorised(stated, split, "test", declared="stated").count() == 2
    with pytest.raises(Exception, match="declared split differs: a"):
        rel.authorised(stated.replace("train", "test", "stated"), split, "test", declared="stated").collect()


def test_checksum_is_order_free_and_sees_changes(spark):
    rows = [(i, f"r{i % 17}") for i in range(500)]

    def digest(rows):
        df = spark.createDataFrame(rows, "i long, s string")
        return rel.finish_checksum(rel.checksum_limbs(df, F.to_json(F.struct("i", "s"))).first())

    first = digest(rows)
    random.Random(1).shuffle(rows)
    assert digest(rows) == first
    assert digest(rows[:-1]) != first
    assert digest([*rows[:-1], rows[0]]) != first
    assert digest([(i, s.upper()) for i, s in rows]) != first


def test_evaluation_example(spark):
    truth = spark.createDataFrame([("s", 1, 1, "D", None), ("s", 1, 2, "E", False), ("s", 2, 1, "N", None), ("s", 2, 2, "X", True)], "schedule_id string, row_index int, day int, text string, ignore boolean")
    found = spark.createDataFrame([("s", 1, 1, "D"), ("s", 1, 2, "N"), ("s", 2, 1, "N"), ("s", 2, 2, "X")], "schedule_id string, row_index int, day int, text string")
    row = rel.evaluate_cells(truth, found).first()
    assert (row["cells"], row["cell_exact"], row["row_accuracy"], row["schedule_accuracy"], row["false_positives"]) == (3, 0.666666667, 0.5, 0.0, 1)


def test_evaluation_keeps_the_last_of_a_key(spark):
    truth = spark.createDataFrame([("s", 1, 1, "D", None, 1), ("s", 1, 1, "E", None, 2), ("s", 1, 2, "N", None, 3)], "schedule_id string, row_index int, day int, text string, ignore boolean, at int")
    found = spark.createDataFrame([("s", 1, 1, "E", 9), ("s", 1, 1, "D", 4), ("s", 1, 2, None, 5)], "schedule_id string, row_index int, day int, text string, at int")
    row = rel.evaluate_cells(truth, found, F.col("at")).first()
    assert (row["cells"], row["cell_exact"], row["cer"]) == (2, 0.5, 0.5)


_ROUTE = "route string, split string, accuracy double, p95 double, mem double"


@pytest.mark.parametrize(("rows", "want"), [
    ([("A", 0.900, 80.0, 9.0), ("B", 0.99, 1.0, 1.0), ("C", 0.899, 70.0, 9.0), ("D", 0.903, 100.0, 10.0)], "C"),  # both fit, C is faster
    ([("A", 0.900, 80.0, 9.0), ("B", 0.99, 1.0, 1.0), ("C", 0.890, 70.0, 9.0), ("D", 0.903, 100.0, 10.0)], "A"),  # C loses too much
    ([("A", 0.900, 90.0, 8.5), ("B", 0.80, 1.0, 1.0), ("C", 0.9, 99.0, 8.6), ("D", 0.903, 100.0, 10.0)], "A"),  # saved memory counts
    ([("A", 0.80, 1.0, 1.0), ("B", 0.95, 9.0, 9.0), ("C", 0.80, 1.0, 1.0), ("D", 0.90, 100.0, 10.0)], "B"),  # none fits: the most accurate
    ([("A", 0.80, 1.0, 1.0), ("B", 0.95, 9.0, 9.0), ("C", 0.80, 1.0, 1.0), ("D", 0.95, 8.0, 10.0)], "D"),  # then the fastest
])
def test_route_selection(spark, rows, want):
    frame = spark.createDataFrame([(r, "validation", *x) for r, *x in rows], _ROUTE)
    assert rel.choose_route(frame).first()["route"] == want
    for bad in (frame.where("route <> 'B'"), frame.replace("validation", "test", "split")):
        with pytest.raises(Exception, match="validation results of each"):
            rel.choose_route(bad).collect()


def test_profile_selection(spark):
    schema = "profile string, split string, usable boolean, accuracy_loss double, p95 double, mem double, size double"
    rows = [("a", "validation", True, 0.001, 5.0, 1.0, 1.0), ("b", "validation", None, 0.004, 4.0, 1.0, 1.0), ("c", "validation", True, None, 1.0, 1.0, 1.0), ("d", "validation", False, 0.0, 1.0, 1.0, 1.0)]
    assert rel.choose_profile(spark.createDataFrame(rows, schema)).first()["profile"] == "b"
    with pytest.raises(Exception, match="no profile"):
        rel.choose_profile(spark.createDataFrame(rows[2:], schema)).collect()
    with pytest.raises(Exception, match="validation results only"):
        rel.choose_profile(spark.createDataFrame(rows, schema).replace("validation", "test", "split")).collect()


def test_best_epoch_modes(spark):
    frame = spark.createDataFrame([("p", 1, 0.5, 3.0), ("p", 2, 0.7, 2.0), ("p", 3, 0.7, 1.0), ("p", 4, 0.4, 9.0)], "p string, e int, m double, t double")
    assert rel.running_best(frame, "p", "e", "m", "t").first()["epoch"] == 3
    assert rel.running_best(frame, "p", "e", "m", "t", mode="min").first()["epoch"] == 4


def test_polygons(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]], [[2.0, 0.0], [6.0, 0.0], [6.0, 2.0], [2.0, 2.0]], [[0.0, 0.0], [4.0, 2.0], [4.0, 0.0], [0.0, 2.0]])], "p array<array<double>>, q array<array<double>>, bow array<array<double>>")
    row = df.select(
        exprs.polygon_area(F.col("p")).alias("area"), exprs.bounding_box(F.col("q")).alias("box"), exprs.is_convex_quad(F.col("p")).alias("ok"), exprs.is_convex_quad(F.col("bow")).alias("bad"),
        udfs.polygon_iou("p", "q").alias("iou"), exprs.corner_distance(F.col("p"), F.col("q")).alias("d"), exprs.apply_homography(F.col("p"), [1, 0, 5, 0, 1, 0, 0, 0, 1])[0].alias("h"),
        exprs.expand_quad(F.col("p"), 2.0)[0].alias("e"), udfs.minimum_area_quad("p").alias("m"), exprs.width_bucket(exprs.quad_width(F.col("p"))).alias("w"), exprs.box_iou(exprs.bounding_box(F.col("p")), exprs.bounding_box(F.col("q"))).alias("b"),
    ).first()
    assert (row["area"], row["box"], row["ok"], row["bad"], row["d"], row["h"], row["e"], row["w"]) == (8.0, [2.0, 0.0, 6.0, 2.0], True, False, 2.0, [5.0, 0.0], [-2.0, -1.0], 160)
    assert row["iou"] == pytest.approx(1 / 3) and row["b"] == pytest.approx(1 / 3)
    assert abs(udfs._area(np.array([list(x) for x in row["m"]]))) == pytest.approx(8)
    assert udfs.convex_iou(None, [[0, 0]]) == 0.0


def test_convex_iou_against_sampling():
    rng = np.random.default_rng(1)
    for _ in range(5):
        p, q = (udfs.convex_hull(rng.random((8, 2))) for _ in range(2))
        points = rng.random((60_000, 2))
        inside = lambda poly: np.all([(b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) >= 0 for a, b in zip(poly, np.roll(poly, -1, 0), strict=True)], axis=0)
        a, b = inside(p), inside(q)
        assert udfs.convex_iou(p, q) == pytest.approx((a & b).sum() / max(1, (a | b).sum()), abs=0.03)


def test_grouped_algorithms():
    boxes = [(0, 0, 10, 10), (20, 1, 30, 11), (0, 30, 10, 40), (20, 29, 30, 39)]
    assert grouped.row_clusters(boxes) == [0, 0, 1, 1]
    items = [("1", (50, 0, 60, 10)), ("2", (70, 0, 80, 10)), ("3", (90, 0, 100, 10)), ("Kim", (0, 20, 30, 30)), ("D", (50, 20, 60, 30)), ("E", (70, 20, 80, 30)), ("N", (90, 20, 100, 30))]
    cells, summary = grouped.align_headers(items)
    assert cells == [(1, 0, "Kim", "name"), (1, 1, "D", "shift_code"), (1, 2, "E", "shift_code"), (1, 3, "N", "shift_code")]
    assert summary == {"confidence": pytest.approx(0.55 * 3 / 20 + 0.45), "header_count": 3, "spacing": 20.0, "missing_columns": list(range(4, 32)), "failure": None}
    # days 1, 2, 5 at 55, 75, 135: gaps 20 and 60, so 40; day 3 at 115, day 4 (from 5, placed before 3) at 95
    wide = [("1", (50, 0, 60, 10)), ("2", (70, 0, 80, 10)), ("5", (130, 0, 140, 10)), ("D", (110, 20, 120, 30)), ("N", (90, 20, 100, 30)), ("x", (35, 20, 37, 30))]
    cells, summary = grouped.align_headers(wide)
    assert summary["spacing"] == 40 and cells == [(1, 0, "x", "name"), (1, 4, "N", "shift_code"), (1, 3, "D", "shift_code")]
    assert grouped.align_headers([]) == ([], {"confidence": 0.0, "header_count": 0, "spacing": None, "missing_columns": [], "failure": "no_rows"})
    assert grouped.align_headers(items[3:])[1]["failure"] == "date_header_not_found"
    assert grouped.topology_bands([(0, 10), (0.2, 10.1), (20, 30), (0, 10)]) == [1, 1, 2, 1]
    assert grouped.topology_bands([(0, 10)] * 5 + [(4, 14), None]) == [1] * 5 + [2, None]  # base 10: 4 px of shift exceed 2.5
    assert grouped.topology_bands([(0, 10)] * 5 + [(0, 60), (0, 62), (0, 63)]) == [1] * 5 + [2, 2, 3]  # boundaries may differ by 2.5 too, however long the spans
    assert grouped.topology_bands([(0, 10), (1, 8)]) == [1, 1]  # 7 of 10 in common, boundaries 1 and 2 apart
    assert grouped.topology_bands([(0, 10), (2, 8)]) == [2, 1]  # extents too unlike; of one centre, the shorter first
    assert grouped.row_clusters([(0, 0, 1, 0.2), (5, 0.5, 6, 0.7)]) == [0, 0]  # heights count as 1 at least
    assert grouped.single_linkage([[0.0], [0.4], [5.0], [0.8]], 0.5) == [0, 0, 1, 0]
    square = lambda x: [[x, 0], [x + 10, 0], [x + 10, 10], [x, 10]]
    assert [(a, b) for a, b, _ in grouped.greedy_match([square(0), square(2), square(50)], [square(1), square(0)])] == [(0, 1), (1, 0)]


def test_text_functions(spark):
    row = spark.createDataFrame([("é", "STRASSE", "straße", "oFF", [0, 3, 3, 0, 3, 5])], "a string, b string, c string, d string, steps array<int>").select(
        udfs.nfc("a").alias("n"), (udfs.casefold("b") == udfs.casefold("c")).alias("same"), exprs.ctc_decode(F.col("steps")).alias("ctc"), exprs.column_letters(F.lit(703)).alias("col"), exprs.mutate_case(F.col("d"), 1, F.lit(1), 1.0).alias("flip"), exprs.flexible_boolean(F.lit("Yes")).alias("t"), exprs.nullable_number(F.lit(" "), "double").alias("x")
    ).first()
    assert tuple(row) == ("é", True, [3, 3, 5], "AAA", "Off", True, None)
    with pytest.raises(Exception, match="not a number"):
        spark.range(1).select(exprs.nullable_number(F.lit("NaN"), "double")).collect()
    codes = spark.createDataFrame([("OFF", 1), ("Off", 2), ("off", 3)], "code string, ord int")
    got = {r["t"]: r["canonical"] for r in rel.canonicalise(spark.createDataFrame([("OFF",), (" oFF",), ("zz",)], "t string"), "t", codes).collect()}
    assert got == {"OFF": "OFF", " oFF": "off", "zz": None}
    codes = spark.createDataFrame([("Stra\u00dfe", 1), ("caf\u00e9", 2)], "code string, ord int")
    aliases = spark.createDataFrame([("CAF\u00c9", "coffee")], "alias string, code string")
    texts = spark.createDataFrame([("STRASSE",), ("\u2003cafe\u0301\t",), (None,)], "t string")
    assert {r["canonical"] for r in rel.canonicalise(texts, "t", codes).collect()} == {"Stra\u00dfe", "caf\u00e9", None}
    assert {r["canonical"] for r in rel.canonicalise(texts, "t", codes, aliases).collect()} == {"Stra\u00dfe", "coffee", None}
    row = spark.createDataFrame([("31", "32", "1,234", "x", "\uac00a\ud7a3")], "a string, b string, c string, d string, e string").select(exprs.date_token(F.col("a")), exprs.date_token(F.col("b")), exprs.grouped_number(F.col("c")), exprs.grouped_number(F.col("d")), exprs.hangul_count(F.col("e"))).first()
    assert tuple(row) == (True, False, 1234, None, 2)


def test_plausible_quads(spark):
    quads = [[[0, 0], [10, 0], [10, 10], [0, 10]], [[0, 0], [100, 0], [100, 2], [0, 2]], [[0, 0], [10, 0], [20, 0.3], [0, 9]], [[0, 0], [10, 0], [2, 2], [0, 10]], [[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1]], None]
    frame = spark.createDataFrame([(i, None if q is None else [[float(x) for x in p] for p in q]) for i, q in enumerate(quads)], "i int, q array<array<double>>")
    got = [r["ok"] for r in frame.select("i", exprs.plausible_quad(F.col("q"), F.lit(100), F.lit(100)).alias("ok")).orderBy("i").collect()]
    assert got == [True, False, False, False, False, False]  # plain, 50 to 1, an angle of 178 degrees, not convex, too small, null
    box = F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4)))
    row = frame.where("i in (0, 5)").orderBy("i").select(exprs.first_polygon(F.col("q"), box=box).alias("p")).collect()
    assert row[0]["p"] == [[0, 0], [10, 0], [10, 10], [0, 10]] and row[1]["p"] == [[1, 2], [3, 2], [3, 4], [1, 4]]


def test_tables_as_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i long, s string")
    assert rel.multiset_difference(a, a.repartition(3), ["i", "s"]).count() == 0
    assert rel.multiset_difference(a, a.distinct(), ["i", "s"]).collect() == [(1, "x", 2, 1)]
    canonical = F.to_json(F.struct("i", "s"))
    good = rel.finish_checksum(rel.checksum_limbs(a, canonical).first())
    assert rel.verified_scan(a, canonical, good).count() == 3
    with pytest.raises(ValueError, match="checksum"):
        rel.verified_scan(a.limit(2), canonical, good)
    assert [r["i"] for r in rel.missing_from(a, a.where("i = 1"), "i").collect()] == [2]
    with pytest.raises(ValueError, match="missing columns"):
        rel.require_columns(a, ["i", "z"])
    assert {r["i"] for r in rel.known_ids(a, spark.createDataFrame([(3,)], "i long"), "i").collect()} == {1, 2, 3}
    assert rel.all_families(a, spark.createDataFrame([(5,)], "i long")).count() == 4


def test_unnest_and_predictions(spark):
    nested = spark.createDataFrame([("p", [("a", 1), ("b", 2)]), ("q", [])], "id string, rows array<struct<name:string,n:int>>")
    assert rel.unnest_rows(nested, "rows", ["id"]).collect() == [("p", 1, "a", 1), ("p", 2, "b", 2)]
    truth = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [0.0])], "k int, box array<double>")
    found = spark.createDataFrame([(1, [9.0], 0.45, 0.35), (2, [9.0], 0.44, 0.9)], "k int, box array<double>, gt_iou double, confidence double")
    assert {(r["k"], r["box"][0], r["box_source"]) for r in rel.or_jitter(truth, found, "k", "box").collect()} == {(1, 9.0, "prediction"), (2, 0.0, "jitter"), (3, 0.0, "jitter")}
    checks = spark.createDataFrame([(True, True), (True, None)], "a boolean, b boolean").select(rel.registration_accepted([F.col("a"), F.col("b")]).alias("ok")).collect()
    assert [r["ok"] for r in checks] == [True, False]


def test_nearest_rank(spark):
    for n in range(6):
        values = [float(i * i) for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<double>").select(exprs.nearest_rank(F.col("v"), 0.5).alias("x")).first()["x"]
        assert got == (sorted(values)[round((n - 1) * 0.5)] if n else 0.0)


def test_round_trips(spark, tmp_path):
    base = spark.createDataFrame([("s1", [[0.0, 1.5], [2.0, 3.0]], 1, True), ("s2", None, None, None)], "schedule_id string, cell_polygon array<array<double>>, day long, ignore boolean")
    rows = io.aligned(base, io.OBJECTS)
    io.write_jsonl(rows, str(tmp_path / "j"))
    io.write_csv(rows, str(tmp_path / "c"))
    want = sorted(map(str, rows.collect()))
    assert sorted(map(str, io.read_jsonl(spark, str(tmp_path / "j"), io.OBJECTS).collect())) == want
    assert sorted(map(str, io.read_csv(spark, str(tmp_path / "c"), io.OBJECTS).collect())) == want
    with pytest.raises(Exception, match="already exists"):
        io.write_jsonl(rows, str(tmp_path / "j"))
    io.write_shards(rows.withColumn("split", F.lit("train")), str(tmp_path / "p"), "split", ["schedule_id"])
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'train'").count() == 2
    folder = tmp_path / "p" / "split=train"
    names = [p.name for p in folder.glob("*.parquet")]
    assert io.read_declared(spark, str(folder), names, io.OBJECTS).count() == 2
    with pytest.raises(ValueError, match="unexpected"):
        io.read_declared(spark, str(folder), [], io.OBJECTS)
    assert {r["sha256"] for r in io.file_hashes(spark, str(folder)).collect()} >= {hashlib.sha256((folder / names[0]).read_bytes()).hexdigest()}


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schedules": [{"schedule_id": "a"}, {"schedule_id": "b"}]}))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("schedule_id", T.StringType())])
    assert io.read_manifest(spark, str(tmp_path / "m.json"), schema).count() == 2
    (tmp_path / "set.txt").write_text("# note\n@chars +/é\n@range 0041-0043\n@range AC00-AC01\n")
    assert {r["ch"] for r in io.charset(spark, str(tmp_path / "set.txt")).collect()} == set("+/éABC가각")
    (tmp_path / "deep" / "x").mkdir(parents=True)
    (tmp_path / "deep" / "x" / "1.registration.json").write_text('{"schedule_id": "a"}')
    (tmp_path / "deep" / "other.json").write_text('{"schedule_id": "b"}')
    assert [r["schedule_id"] for r in io.read_registrations(spark, str(tmp_path / "deep"), schema).collect()] == ["a"]


def test_stream_matches_batch(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.windowed(stream.read_events(spark, str(tmp_path / "in")), late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = sum(r["n"] for r in spark.sql("select n from w").collect())
    assert got == spark.read.parquet(f"{small}/events.parquet").count()


def test_cv_partition_refuses_other_splits(spark):
    rows = spark.createDataFrame([(1, "train", 0), (2, "train", 1)], "id long, split string, fold int")
    roles = {r["id"]: r["role"] for r in rel.cv_partition(rows, F.col("fold"), 1).collect()}
    assert roles == {1: "train", 2: "validation"}
    for other in ("test", None):
        bad = rows.union(spark.createDataFrame([(3, other, 0)], rows.schema))
        with pytest.raises(Exception, match="not a train row"):
            rel.cv_partition(bad, F.col("fold"), 1).collect()


def test_filled_from_nulls_and_absent_rows(spark):
    stated = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c"), (None, None)], "id long, kind string")
    expected = spark.createDataFrame([(1, "x"), (2, "a"), (3, "x")], "id long, kind string")
    found = {r["id"]: (r["kind"], r["conflict"]) for r in rel.filled_from(stated, expected, "id", "kind").collect()}
    assert found == {1: ("x", False), 2: ("a", False), 3: ("b", True), 4: ("c", False), None: (None, False)}
