"""Operators against brute force on small frames."""

import random

from pyspark.sql import functions as F

from contactsheet import fixtures
from contactsheet.operators import catalog, dedup, geo, similar, transcode
from contactsheet.plans import ledger, plan
from contactsheet.queries import QUERIES


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = similar.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["file_id"]: r["group_id"] for r in got} == want


def test_time_neighbors_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(300)) if rng.random() < 0.9 else None, None) for i in range(120)]
    rows = [(i, t, t - 8 * 3600 if t is not None and rng.random() < 0.5 else None) for i, t, _ in rows]
    want = set()
    for i, (a, la, ua) in enumerate(rows):
        for b, lb, ub in rows[i + 1 :]:
            gap = abs(ua - ub) if ua is not None and ub is not None else abs(la - lb) if la is not None and lb is not None else None
            if gap is not None and gap <= 10:
                want.add((a, b))
    got = similar.time_neighbors(spark.createDataFrame(rows, "file_id long, local_s double, utc_s double")).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_allocate_targets(spark):
    claims = [(1, "/in/a.jpg", "/d", "a.jpg"), (2, "/in/x/a.jpg", "/d", "a.jpg"), (3, "/in/y/a.jpg", "/d", "a.jpg"), (4, "/in/a_1.jpg", "/d", "a_1.jpg"), (5, "/d/b.jpg", "/d", "b.jpg"), (6, "/in/b.jpg", "/d", "b.jpg")]
    there = [("/d/a.jpg",), ("/d/a_2.jpg",), ("/d/b.jpg",)]
    got = plan.allocate_targets(spark.createDataFrame(claims, "file_id long, path string, dest_dir string, name string"), spark.createDataFrame(there, "path string")).collect()
    got = {r["file_id"]: r["target"] for r in got}
    assert got == {1: "/d/a_3.jpg", 2: "/d/a_4.jpg", 3: "/d/a_5.jpg", 4: "/d/a_1.jpg", 5: "/d/b.jpg", 6: "/d/b_1.jpg"}


def test_allocation_equals_serving_in_turn(spark, monkeypatch):
    monkeypatch.setattr(plan, "BLOCK", 4)
    rng = random.Random(11)
    names = ["a.jpg", "a_1.jpg", "a_3.jpg", "b.png", "b_2.png", "c"]
    claims = [(i, f"/in/{i}/x", rng.choice(["/d", "/e"]), rng.choice(names)) for i in rng.sample(range(-500, 500), 150)]
    there = {f"/d/{n}" for n in ("a.jpg", "a_2.jpg", "a_7.jpg", "b_1.png")} | {f"/e/a_{k}.jpg" for k in range(1, 40, 3)}
    taken, want = set(there), {}
    for i, _, folder, name in sorted(claims):  # plain names first, then numbers in turn
        if f"{folder}/{name}" not in taken:
            want[i] = f"{folder}/{name}"
            taken.add(want[i])
    for i, _, folder, name in sorted(claims):
        if i not in want:
            stem, dot, ext = name.partition(".")
            want[i] = next(p for k in range(1, 10**4) if (p := f"{folder}/{stem}_{k}{dot}{ext}") not in taken)
            taken.add(want[i])
    got = plan.allocate_targets(spark.createDataFrame(claims, "file_id long, path string, dest_dir string, name string"), spark.createDataFrame([(p,) for p in there], "path string")).collect()
    assert {r["file_id"]: r["target"] for r in got} == want and len(set(want.values())) == len(want)


def test_transcoding_again(spark):
    rows = [(1, "/library/X/a.mov", "a.mov", ".mov", 5, "hvc1", "/library/X"), (2, "/library/X/b.mp4", "b.mp4", ".mp4", 5, "hvc1", "/library/X"), (3, "/library/X/c.mov", "c.mov", ".mov", 5, "ap4h", "/library/X"), (4, "/library/X/d.mov", "d.mov", ".mov", 0, "hvc1", "/library/X")]
    media = spark.createDataFrame(rows, "file_id long, path string, filename string, extension string, size long, codec string, directory string")
    ids = lambda **k: sorted(r["file_id"] for r in transcode.transcode_candidates(media, **k).collect())
    assert (ids(), ids(recompress=True)) == ([3], [1, 3])


def test_orientation_of_scanned_photos_only(spark):
    rows = [(i, f"/x{e}", e, 6) for i, e in enumerate((".jpg", ".heic", ".heif", ".bmp", ".webp", ".mov"))]
    got = catalog.orientation_issues(spark.createDataFrame(rows, "file_id long, path string, extension string, orientation int"))
    assert sorted(r["file_id"] for r in got.collect()) == [0, 1, 4]


def test_roots_in_the_filter_or_joined(spark, monkeypatch):
    media = spark.createDataFrame([(i, p) for i, p in enumerate(["/a/b/c.jpg", "/a/x.jpg", "/ab/x.jpg", "/a", "/q/r.jpg"])], "file_id long, path string")
    roots = spark.createDataFrame([(0, "/a/b"), (1, "/a"), (2, "/q/r")], "ord int, base_dir string")
    made = []
    for few in (200, 1):
        monkeypatch.setattr(geo, "FEW_ROOTS", few)
        made.append((sorted(tuple(r) for r in geo.assign_base(media, roots).collect()), sorted(r["file_id"] for r in geo.access_filter(media, roots).collect())))
    assert made[0] == made[1] and made[0][1] == [0, 1, 3] and [b for _, _, b in made[0][0]] == ["/a/b", "/a", "/ab", "/a", "/q"]


def test_outcomes_of_actions(spark):
    rows = spark.createDataFrame([("x", 1, "/a", "ok"), ("x", 2, "/b", "File not found")], "op_key string, file_id long, path string, status string")
    assert sorted(map(tuple, plan.action_outcomes(rows).collect())) == [("x", 1, "/a", True, None), ("x", 2, "/b", False, "File not found")]
    assert [tuple(r) for r in plan.action_result(rows).collect()] == [("x", 1, 1)]


def test_only_moves_of_non_photos_are_capped(spark):
    n = 10_050
    files = spark.range(n).select(F.col("id").alias("file_id"), F.format_string("/in/%d/a.jpg", "id").alias("path"), F.lit("a.jpg").alias("filename"), F.lit("Unknown").alias("label"), F.lit("other").alias("category"))
    placed = plan.location_move_plan(files, files).agg(F.count("target"), F.countDistinct("target"), F.count("*")).head()
    assert tuple(placed) == (n, n, n)
    claims = files.select("file_id", "path", F.lit("/d").alias("dest_dir"), F.col("filename").alias("name"))
    assert plan.allocate_targets(claims, files).where("target is null").count() == 0
    assert plan.move_plan(files, files).where("target is null").count() == n - 10_000


def test_date_places_of_all_photos(spark, tmp_path):
    rng = random.Random(4)
    dates = [rng.choice(["2024:01:05 03:04:05", "2024:01:05 03:04:06", "1969:12:31 23:59:59", "2024-01-06T00:00:00", None, "bad"]) for _ in range(300)]
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(250)] + list(range(50))
    media = spark.createDataFrame([(i, ".jpg", d) for i, d in zip(ids, dates)], "file_id long, extension string, date_raw string")
    media = media.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("gps_lat", "double"), ("gps_lon", "double"), ("size", "long"), ("width", "int"), ("height", "int"), ("phash_bits", "string"))))
    want = [r["file_id"] for r in similar.date_order(media).collect()]
    got = similar.date_places(media).collect()
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(1, 301))
    assert [r["file_id"] for r in sorted(got, key=lambda r: r["place"])] == want
    query = QUERIES["date_order"](spark, "/root/testdata/sf0.001")
    assert query.count() == similar.shots(fixtures.media(spark, "/root/testdata/sf0.001")).count() > query.where("local_s is not null").count()


def test_exact_duplicates(spark):
    files = spark.createDataFrame([(1, "xx"), (2, "xx"), (3, "xy"), (4, ""), (5, ""), (6, None)], "file_id long, content string")
    got = dedup.exact_duplicates(files, size=F.octet_length("content").cast("bigint")).collect()
    assert [(r["count"], r["first_id"], r["wasted_size"]) for r in got] == [(2, 1, 2)]


def test_keep_policy_without_dates(spark):
    rows = spark.createDataFrame([(0, 1, 5, None, 1), (0, 2, 9, None, 3), (0, 3, 9, None, 2)], "group_id long, file_id long, size long, date_raw string, quality long")
    kept = lambda p: [r["file_id"] for r in dedup.keep_policy(rows, p).where("state = 'keep'").collect()]
    assert (kept("first"), kept("newest"), kept("largest"), kept("best"), kept("clear")) == ([1], [1], [2], [2], [])


def test_nearest_place_across_the_date_line(spark):
    places = spark.createDataFrame([(1, 0.0, 179.9, "P", None, None, None, "X", "xx"), (2, 10.0, 10.0, "Q", None, None, None, "X", "en")], "place_id long, lat double, lon double, city string, town string, county string, state string, country string, country_code string")
    keys = spark.createDataFrame([("0.00,-179.90",), ("10.01,10.00",), ("50.00,50.00",)], "geo_key string")
    got = {r["geo_key"]: r["label"] for r in geo.nearest_place(keys, places).collect()}
    assert got == {"0.00,-179.90": "X_P", "10.01,10.00": "Q", "50.00,50.00": "Unknown"}


def test_undo_is_the_inverse(spark):
    ops = spark.createDataFrame([(1, 1, "RENAME", "/a", "/a", "/b"), (1, 2, "RENAME", "/b", "/b", "/c")], "session_id int, file_id long, type string, file string, old_value string, new_value string")
    flat = ledger.ledger_append(ops).withColumn("undone", F.lit(False))
    rows = ledger.undo_plan(flat, spark.createDataFrame([("/c",), ("/b",)], "path string")).orderBy("step").collect()
    assert [(r["source"], r["target"], r["success"]) for r in rows] == [("/c", "/b", True), ("/b", "/a", True)]


def test_history_has_no_window_over_all_rows(spark):
    rng = random.Random(5)
    times = ["2024-01-05T10:00:00", "2024-01-05T10:00:01", "2024-01-05T11:00:00", "2023-12-31T00:00:00", "", None]
    rows = [(rng.choice(["/a", "/b"]), k, rng.choice(times), k % 3, False) for k in range(200)]
    parts = [spark.createDataFrame([r for r in rows if (r[0] == x)], "root string, session_id int, timestamp string, operations int, undone boolean") for x in ("/a", "/b")]
    got = ledger.history(*parts)
    want = sorted(rows, key=lambda r: (r[2] is None, [-ord(c) for c in r[2] or ""] + [0], r[0], r[1]))
    assert [(r["root"], r["session_id"]) for r in sorted(got.collect(), key=lambda r: r["index"])] == [r[:2] for r in want] and got.agg(F.max("index")).head()[0] == 199
    ranks = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in line]
    assert len(ranks) == 1 and "[_day" in ranks[0]
