"""Files made here: metadata dumps, listings, pictures, logs, and streams."""

import hashlib
import json
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from contactsheet.operators import geo
from contactsheet.plans.ledger import SESSION_SCHEMA
from contactsheet.queries import QUERIES
from contactsheet.sources import images, jsonarray, metadata
from contactsheet.streaming import streams


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_metadata_dump(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"SourceFile": "/x/a.jpg", "FileSize": 5}, {"SourceFile": "/x/b.jpg", "GPSLatitude": 1.5}]))
    (tmp_path / "b.json").write_text("[{ broken")
    got = {r["SourceFile"]: r["FileSize"] for r in metadata.read_exif_json(spark, str(tmp_path)).collect()}
    assert got == {"/x/a.jpg": "5", "/x/b.jpg": None}


def test_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.JPG").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    got = metadata.scan_files(spark, str(tmp_path), (".jpg",)).collect()
    assert [(r["filename"], r["extension"], r["size"], r["directory"]) for r in got] == [("A.JPG", ".jpg", 3, f"{tmp_path}/sub")]


def test_operation_log(spark, tmp_path):
    assert metadata.read_operation_log(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "log.json").write_text(json.dumps([{"session_id": 1, "timestamp": "t", "operations": [{"type": "TRASH", "file": "/a"}], "undone": False}]))
    assert metadata.read_operation_log(spark, str(tmp_path / "log.json")).head()["operations"][0]["type"] == "TRASH"


def test_operation_log_is_written_and_read_back(spark, tmp_path):
    ops = [("TRASH", "/a", None, None, "x"), ("GPS", "/b", "1,2", "3,4", "")]
    sessions = spark.createDataFrame([(1, "t1", ops, False, None), (2, "t2", [], True, "t3")], SESSION_SCHEMA)
    metadata.write_operation_log(sessions, str(tmp_path / "log"))
    back = metadata.read_operation_log(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sessions.collect()))
    for broken in ("[{ broken", "", '{"session_id": "none"}', '[{"timestamp": "t"}]'):
        (tmp_path / "bad.json").write_text(broken)
        assert metadata.read_operation_log(spark, str(tmp_path / "bad.json")).count() == 0


def test_catalog_by_location(spark, tmp_path):
    rows = [(1, "/a", "X_Y"), (2, "/b", "X_Y"), (3, "/c", "Unknown")]
    metadata.write_by_location(spark.createDataFrame(rows, "file_id long, path string, label string"), str(tmp_path / "out"))
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == ["label=Unknown", "label=X_Y"]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("file_id", "path", "label").collect()) == rows


def test_geocode_cache_versions(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert metadata.load_cache(spark, at).count() == 0
    one = spark.createDataFrame([("1.00,2.00", "A"), ("3.00,4.00", "B")], metadata.CACHE_SCHEMA)
    assert metadata.save_cache(one, at) == 1
    more = spark.createDataFrame([("1.00,2.00", "new"), ("5.00,6.00", "C")], metadata.CACHE_SCHEMA)
    assert metadata.save_cache(geo.merge_cache(metadata.load_cache(spark, at), more), at) == 2
    assert sorted(map(tuple, metadata.load_cache(spark, at).collect())) == [("1.00,2.00", "A"), ("3.00,4.00", "B"), ("5.00,6.00", "C")]


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((16, 16, 1)))
    png(tmp_path / "a.png", base)
    png(tmp_path / "b.png", np.clip(base + rng.integers(-3, 3, base.shape), 0, 255))
    png(tmp_path / "c.png", 255 - base)
    (tmp_path / "bad.png").write_bytes(b"no picture")
    pictures = images.read_images(spark, str(tmp_path))
    got = {r["path"][-5:]: r["hash64"] for r in images.hashed_images(pictures).collect()}
    apart = lambda x, y: bin((got[x] ^ got[y]) & (2**64 - 1)).count("1")
    assert len(got) == 3 and apart("a.png", "b.png") <= 6 and apart("a.png", "c.png") >= 40
    scored = images.score_images(pictures, lambda x: x.mean(axis=(2, 3)) @ np.ones((3, 4))).collect()
    assert len(scored) == 3 and len(scored[0]["logits"]) == 4
    assert images.score_images(pictures, None).count() == 0


def test_streams_equal_batch(spark, tmp_path):
    ts = pa.array(np.arange("2024-01-01T00:00:00", "2024-01-01T00:10:00", 7, dtype="datetime64[s]").astype("datetime64[us]"))
    n = len(ts)
    pq.write_table(pa.table({"event_id": pa.array(range(n)), "ts": ts, "user_id": pa.array([i % 3 for i in range(n)]), "event_type": ["A"] * n, "value": [0.5] * n, "props": ["{}"] * n}), tmp_path / "events.parquet")
    events = lambda: streams.read_events(spark, str(tmp_path))
    where = str(tmp_path / "out")
    rows = QUERIES["ingest_stream"](spark, str(tmp_path)).orderBy("file_id").collect()
    assert len(rows) == n and tuple(rows[1])[:6] == (1, "/in/1/A_1.JPG", "A_1.JPG", ".jpg", 10, "2024:01:01 00:00:07")
    assert streams.run_available(streams.distinct_values(events(), "user_id").select("user_id"), where).count() == 3
    batch = spark.read.parquet(str(tmp_path / "events.parquet")).withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(streams.run_available(streams.burst_sessions(events(), 21), where, "complete")) == key(streams.burst_sessions(batch, 21))


def test_streams_of_many_mixed_files_equal_batch(spark, tmp_path):
    """Twelve files, each with times of all 200 days: three batches, whose later rows are older than the first's newest."""
    n, rng = 1200, np.random.default_rng(3)
    days, user = rng.permutation(n) % 200, np.arange(n) % 7
    user = np.where((days < 100) & (np.arange(n) % 12 >= 8), user + 7, user)
    ts = np.datetime64("2024-01-01T00:00:00", "us") + days.astype("timedelta64[D]") + rng.integers(0, 3600, n).astype("timedelta64[s]")
    (tmp_path / "events.parquet").mkdir()
    for k in range(12):
        own = np.arange(n) % 12 == k
        own = pa.table({"event_id": np.flatnonzero(own), "ts": pa.array(ts[own]), "user_id": user[own], "event_type": ["A"] * own.sum(), "value": [0.5] * own.sum(), "props": [f"file {u}" for u in user[own]]})
        pq.write_table(own, tmp_path / "events.parquet" / f"part-{k:02}.parquet")
    batch = spark.read.parquet(str(tmp_path / "events.parquet")).withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    key = lambda df: sorted(map(tuple, df.collect()))
    hashes = key(QUERIES["dedup_stream"](spark, str(tmp_path)))
    assert hashes == sorted((hashlib.md5(f"file {u}".encode()).hexdigest(),) for u in set(user))
    late = streams.run_available(streams.distinct_values(streams.read_events(spark, str(tmp_path)), "user_id", late="400 days").select("user_id"), str(tmp_path / "late"))
    assert key(late) == key(batch.select("user_id").distinct())
    sessions = key(QUERIES["burst_sessions"](spark, str(tmp_path)))
    assert (sum(r[1] for r in sessions), sessions) == (n, key(streams.burst_sessions(batch, 600)))


def test_sessions_of_a_live_stream_are_given_once(spark, tmp_path):
    """Append mode: with a bound on lateness state is freed, and sessions come once the stream has moved on."""
    n, rng = 600, np.random.default_rng(9)
    ts = np.datetime64("2024-01-01T00:00:00", "us") + rng.integers(0, 86400, n).astype("timedelta64[s]")
    user = np.arange(n) % 5
    (tmp_path / "events.parquet").mkdir()
    for k in range(7):
        own = np.flatnonzero(np.arange(n) % 6 == k) if k < 6 else np.array([0])
        at = ts[own] if k < 6 else np.array([np.datetime64("2024-02-01T00:00:00", "us")])
        rows = pa.table({"event_id": own, "ts": pa.array(at), "user_id": user[own] if k < 6 else np.array([99]), "event_type": ["A"] * len(own), "value": [0.5] * len(own), "props": ["{}"] * len(own)})
        path = tmp_path / "events.parquet" / f"part-{k:02}.parquet"
        pq.write_table(rows, path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    batch = spark.read.parquet(str(tmp_path / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 99")
    live = streams.burst_sessions(streams.read_events(spark, str(tmp_path), files=1), 600, late="2 days")
    got = streams.run_available(live, str(tmp_path / "out"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(streams.burst_sessions(batch, 600)) and got.agg(F.sum("shots")).head()[0] == n


def dump(rng, n):
    """An array of objects with braces, quotes and escapes in strings, nested values, and odd spacing."""
    said = ['}{', '"', '\\', '\\"', '\\\\', '}', '},{', 'ü}', '[', '', 'a\nb', '\\\\"}']
    rows = [{"SourceFile": f"/x/{i}{rng.choice(said)}.jpg", "FileSize": rng.choice([5, 1.5, None]), "FileName": rng.choice(said) * rng.randrange(4), "Nested": {"a": [{"b": rng.choice(said)}, []]}} for i in range(n)]
    return rows, "[" + ",".join(json.dumps(r, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " "]) for r in rows) + "]\n"


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(8)
    want = []
    for k in range(3):
        rows, text = dump(rng, 60)
        (tmp_path / f"{k}.json").write_text(" \n" * k + text)
        want += rows
    (tmp_path / "one.json").write_text('{"SourceFile": "/alone", "FileSize": 1}')
    (tmp_path / "none.json").write_text(" [ \n]")
    (tmp_path / "nothing.json").write_text("")
    want.append({"SourceFile": "/alone", "FileSize": 1})
    key = lambda rows: sorted((r["SourceFile"], str(r["FileSize"]) if r["FileSize"] is not None else "", r.get("FileName") or "") for r in rows)
    for size in (700, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            tasks = jsonarray.pieces(spark, str(tmp_path)).rdd.getNumPartitions()
            got = [r.asDict() for r in metadata.read_exif_json(spark, str(tmp_path)).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert key(got) == key(want) and (tasks > 12 or size > 700)


def test_dumps_that_are_not_sound(spark, tmp_path):
    sound = '{"SourceFile": "/a", "FileSize": 1}'
    broken = [f"[{sound}", f"[{sound},]x", f"[{sound} {sound}]", f"[{sound}, 5]", f'[{sound}, {{"SourceFile": /b}}]', f"[{sound}]]", "[{ broken", f"{sound}}}", f'[{sound}, {{"SourceFile": "]', "text", f"[{sound}],"]
    for k, text in enumerate(broken):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a.json").write_text(text)
        assert metadata.read_exif_json(spark, str(tmp_path / f"{k}")).count() == 0, text
    (tmp_path / "2" / "b.json").write_text(f"[{sound}]")
    assert metadata.read_exif_json(spark, str(tmp_path / "2")).count() == 1
    assert [r["SourceFile"] for r in metadata.read_exif_json(spark, str(tmp_path / "4"), strict=False).collect()] == ["/a"]


def field(n, value):
    """One field of a protocol buffer: a number, a text or a nested message."""
    size = lambda v: bytes([*((v >> s) & 127 | 128 for s in range(0, max(0, v.bit_length() - 1) // 7 * 7, 7)), v >> (max(0, v.bit_length() - 1) // 7 * 7)])
    if isinstance(value, int):
        return size(n << 3) + size(value)
    value = value.encode() if isinstance(value, str) else value
    return size(n << 3 | 2) + size(len(value)) + value


def mean_model():
    """An ONNX model that gives each picture's mean by channel."""
    tensor = lambda name, dims: field(1, name) + field(2, field(1, field(1, 1) + field(2, b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims))))
    nodes = field(1, field(1, "x") + field(2, "m") + field(4, "GlobalAveragePool")) + field(1, field(1, "m") + field(2, "y") + field(4, "Flatten"))
    graph = nodes + field(2, "g") + field(11, tensor("x", ["n", 3, 384, 384])) + field(12, tensor("y", ["n", 3]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_scoring_by_a_model_file(spark, tmp_path, caplog):
    rng = np.random.default_rng(4)
    (tmp_path / "in").mkdir()
    for i in range(3):
        png(tmp_path / "in" / f"{i}.png", rng.integers(0, 255, (30 + i, 40, 3)))
    (tmp_path / "model.onnx").write_bytes(mean_model())
    pictures = images.read_images(spark, str(tmp_path / "in"))
    got = {r["path"]: r["logits"] for r in images.score_images(pictures, images.onnx_scorer(str(tmp_path / "model.onnx")), size=2).collect()}
    plain = {r["path"]: images.preprocess(images.pixels(r["data"], r["height"], r["width"], r["nChannels"])).mean(axis=(1, 2)) for r in pictures.collect()}
    assert got.keys() == plain.keys() and all(np.allclose(got[p], plain[p], atol=1e-4) for p in got)
    assert images.score_images(pictures, None).count() == 0 and "no model" in caplog.text
