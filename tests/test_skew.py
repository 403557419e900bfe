"""Hot keys: one time, one name, one date that very many files share, in tasks that stay small."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from contactsheet.functions.numbering import running_sum, with_block
from contactsheet.operators import dates, similar
from contactsheet.queries import QUERIES

PHOTOS = "file_id long, local_s double, utc_s double, gps_lat double, gps_lon double, size long, width int, height int, hash64 long"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shots(rng, n, at=1000.0, spread=0.0):
    """Photos of one time, a tenth of them within a few bits of others, some with places, instants or neither."""
    out, hashes = [], []
    for i in range(n):
        h = rng.getrandbits(64)
        if hashes and rng.random() < 0.1:
            h = rng.choice(hashes)
            for _ in range(rng.choice([0, 3, 11, 12, 13])):
                h ^= 1 << rng.randrange(64)
        hashes.append(h)
        t = at + rng.random() * spread
        place = (rng.choice([10.0, 10.0001, 40.0]), 5.0) if rng.random() < 0.4 else (None, None)
        out.append((i * 3, None if rng.random() < 0.02 else t, t - 3600 if rng.random() < 0.3 else None, *place, 10, 4, 3, signed(h)))
    return out


def test_a_hot_time_is_compared_in_blocks(spark):
    rng = random.Random(2)
    rows = shots(rng, 900) + [(100_000 + r[0], *r[1:]) for r in shots(rng, 300, 990.0, 60.0)]
    photos = spark.createDataFrame(rows, PHOTOS)
    plain = {tuple(r) for r in similar.similar_edges(photos).collect()}
    assert len(plain) > 60
    for large, block in ((1000, 100), (200_000, 333)):
        assert {tuple(r) for r in similar.similar_edges(photos, large=large, block=block).collect()} == plain
    # Against all pairs, literally.
    h = np.array([r[8] for r in rows]).view(np.uint64)
    near = {(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in zip(*np.nonzero(np.bitwise_count(h[:, None] ^ h[None, :]) <= 12)) if i != j}
    by_id = {r[0]: r for r in rows}

    def close(a, b):
        a, b = by_id[a], by_id[b]
        clock = 2 if a[2] is not None and b[2] is not None else 1
        apart = a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > 1
        return a[clock] is not None and b[clock] is not None and abs(a[clock] - b[clock]) <= 10 and not apart

    assert {(a, b) for a, b, *_ in plain} == {p for p in near if close(*p)}


def test_copies_are_linked_without_all_pairs(spark):
    rng = random.Random(5)
    rows = shots(rng, 200) + [(10_000 + i, 1000.0, None, None, None, 10, 4, 3, signed(77)) for i in range(3000)] + [(20_000, None, None, None, None, 10, 4, 3, signed(77)), (20_001, 1000.0, None, None, None, 10, 4, 3, None)]
    photos = spark.createDataFrame(rows, PHOTOS)
    edges = similar.linking_edges(photos)
    assert edges.count() < 3600
    few = photos.where("file_id < 10050 or file_id >= 20000")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(similar.components(similar.linking_edges(few))) == key(similar.components(similar.similar_edges(few)))


def test_blocks_hold_equally_many_rows(spark):
    ids = [*range(5000), 2**62, -(2**62), None]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = with_block(rows, "id", 64).collect()
    sizes = {}
    for r in got:
        sizes[r["_block"]] = sizes.get(r["_block"], 0) + 1
    assert len(sizes) > 50 and max(sizes.values()) < 400
    order = sorted((r["id"], r["_block"]) for r in got if r["id"] is not None)
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:]))
    summed = running_sum(with_block(rows.where("id is not null").withColumn("k", F.lit(1)), "id", 64), ["k"], "_block", [F.col("id")], F.lit(1), "n")
    assert [r["n"] for r in summed.orderBy("id").collect()] == list(range(1, 5003))
    assert {r["_block"] for r in with_block(spark.createDataFrame([(5,)] * 9, "id long"), "id").collect()} <= {0, 1}
    assert with_block(rows.limit(0), "id").count() == 0 and {r["_block"] for r in with_block(spark.createDataFrame([(None,)], "id long"), "id").collect()} == {0}


def test_renames_of_one_date(spark):
    rows = [(i, f"/d{i % 2}/f{i}.JPG", f"f{i}.JPG", f"/d{i % 2}", "2000:01:01 00:00:00" if i % 5 else f"2001:02:03 00:00:{i % 60:02}") for i in range(700)]
    media = spark.createDataFrame(rows, "file_id long, path string, filename string, directory string, date_raw string")
    got = {r["file_id"]: r["new_name"] for r in dates.rename_plan(media).collect()}
    seen, total = {}, {}
    for i, _, _, d, t in rows:
        total[d, t] = total.get((d, t), 0) + 1
    for i, _, _, d, t in rows:
        seen[d, t] = seen.get((d, t), 0) + 1
        base = t.replace(":", "").replace(" ", "_")
        assert got[i] == base + (f"_{seen[d, t]}" if total[d, t] > 1 else "") + ".jpg"


def shuffled(spark):
    """Rows that stages of this session have written for other stages so far."""
    listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(listed.apply(i).shuffleWriteRecords() for i in range(listed.size()))


def test_pairs_near_in_time_are_gated_without_a_shuffle(spark, tmp_path):
    # An hour in which thousands of files have the same few seconds.
    events = spark.range(4000).selectExpr("id event_id", "timestamp_ntz '2024-01-01 05:00:00' ts", "id % 50 user_id", "'x' event_type", "1e0 value", "'{}' props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40).selectExpr("id vec_id", "transform(sequence(1, 64), i -> cast(if(hash(id, i) > 0, 1, -1) as float)) embedding", "0 label").write.parquet(f"{tmp_path}/embeddings.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        QUERIES["time_neighbors"](spark, str(tmp_path)).count()
        start = shuffled(spark)
        pairs = QUERIES["geo_gate"](spark, str(tmp_path)).collect()
        assert len(pairs) > 300_000 and shuffled(spark) - start < 4000 * 20
    finally:
        spark.conf.set(key, before)


def metres(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    x = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_pairs_of_tiles_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 4)
    monkeypatch.setattr(similar, "TILES", 3)
    rng = random.Random(8)
    rows = shots(rng, 250) + [(10_001 + 2 * r[0], *r[1:]) for r in shots(rng, 150, 960.0, 90.0)]
    rows += [(50_000, float("nan"), None, 10.0, 5.0, 10, 4, 3, 0), (50_001, 1000.0, None, float("nan"), 5.0, 10, 4, 3, 0), (50_002, 1000.0, None, 370.0, 5.0, 10, 4, 3, 0), (50_003, 1000.0, None, 10.0, None, 10, 4, 3, 0)]
    # Ids twice, within a bucket and across two, and none: never pairs of their own.
    rows += [(60_000, 1000.0, None, None, None, 10, 4, 3, 0), (60_000, 1003.0, None, None, None, 10, 4, 3, 0), (60_001, 1009.0, None, None, None, 10, 4, 3, 0), (60_001, 1010.0, None, None, None, 10, 4, 3, 0), (None, 1001.0, None, None, None, 10, 4, 3, 0)]
    near, placed = [], []
    for a in rows:
        for b in rows:
            if a[0] is None or b[0] is None or a[0] >= b[0]:
                continue
            clock = 2 if a[2] is not None and b[2] is not None else 1
            if a[clock] is None or b[clock] is None or not abs(a[clock] - b[clock]) <= 10:
                continue
            near.append((a[0], b[0], abs(a[clock] - b[clock])))
            if None in (*a[3:5], *b[3:5]) or metres(*a[3:5], *b[3:5]) <= 100:
                placed.append((a[0], b[0]))
    photos = spark.createDataFrame(rows, PHOTOS)
    assert sorted(map(tuple, similar.near_in_place(photos).collect())) == sorted(placed) and len(placed) > 30_000
    assert sorted(map(tuple, similar.time_neighbors(photos).collect())) == sorted(near)


def test_pairs_near_in_time_are_written_in_little_room(spark, tmp_path):
    photos = spark.range(3000).selectExpr("(id * 7919) % 100003 file_id", "cast(1000 + id % 3 as double) local_s", "cast(if(id % 11 < 2, local_s - 3600, null) as double) utc_s")
    similar.time_neighbors(photos).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 3000 * 2999 // 4
