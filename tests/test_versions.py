"""Versioned tables under two writers, and what rests on them: ledger, geocode cache, stream index, change capture."""

import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from contactsheet import versions
from contactsheet.plans import ledger
from contactsheet.sources import metadata
from contactsheet.streaming import streams

ROWS = "k int, who string"


def at_once(*work):
    """Runs functions in threads of one session; errors are returned."""
    errors = []

    def guarded(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=guarded, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return errors


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_two_writers_lose_nothing(spark, tmp_path, scheme):
    at = f"{scheme}{tmp_path}/t"
    assert versions.latest(spark, at) == 0 and versions.read(spark, at, ROWS).count() == 0
    add = lambda who: [versions.append(spark.createDataFrame([(k, who)], ROWS), at, spark) for k in range(4)]
    more = lambda: [versions.replace(lambda rows: rows.unionByName(spark.createDataFrame([(9, "r")], ROWS)), at, ROWS, spark) for _ in range(2)]
    assert at_once(lambda: add("a"), lambda: add("b"), more) == []
    assert versions.latest(spark, at) == 10
    want = [(k, w) for w in "ab" for k in range(4)] + [(9, "r")] * 2
    assert sorted(map(tuple, versions.read(spark, at, ROWS).collect())) == sorted(want)
    assert versions.read(spark, at, ROWS, 1).count() == 1


def test_a_manifest_is_created_once(spark, tmp_path):
    assert versions.create_if_absent(spark, f"{tmp_path}/v/1.json", "one") and not versions.create_if_absent(spark, f"{tmp_path}/v/1.json", "two")
    assert [p.read_text() for p in (tmp_path / "v").iterdir()] == ["one"]
    known, versions._local = versions._local, lambda path: None  # the way of other stores, on the local one
    try:
        assert versions.create_if_absent(spark, f"file://{tmp_path}/w/1.json", "one") and not versions.create_if_absent(spark, f"file://{tmp_path}/w/1.json", "two")
    finally:
        versions._local = known
    assert [p.read_text() for p in (tmp_path / "w").iterdir() if p.suffix == ".json"] == ["one"]


def test_turns_of_a_writer_count_once(spark, tmp_path):
    at, row = f"{tmp_path}/t", spark.createDataFrame([(1, "a")], ROWS)
    assert [versions.append(row, at, spark, "s", t) for t in (0, 0, 1, 0)] == [1, 0, 2, 0]
    assert versions.replace(lambda rows: rows, at, ROWS, spark) == 3 and versions.append(row, at, spark, "s", 1) == 0
    assert versions.read(spark, at, ROWS).count() == 2


def test_sessions_get_numbers_and_are_undone_once(spark, tmp_path):
    at = f"{tmp_path}/ledger"
    ops = spark.createDataFrame([(1, "GPS", "/b", None, "1,2", "d"), (0, "TRASH", "/a", None, None, "c")], "pos int, type string, file string, old_value string, new_value string, detail string")
    numbers = []
    assert at_once(*[lambda: numbers.append(ledger.record_session(spark, at, ops, "t")) for _ in range(3)]) == []
    assert sorted(numbers) == [0, 1, 2]
    assert at_once(lambda: ledger.record_undone(spark, at, 1, "t1"), lambda: ledger.record_undone(spark, at, 0, "t0")) == []
    errors = at_once(lambda: ledger.record_undone(spark, at, 2, "x"), lambda: ledger.record_undone(spark, at, 2, "y"))
    assert [type(e) for e in errors] == [ValueError]
    with pytest.raises(IndexError):
        ledger.record_undone(spark, at, 7, "t")
    rows = {r["session_id"]: r for r in ledger.stored_sessions(spark, at).collect()}
    assert [rows[k]["undone"] for k in range(3)] == [True] * 3 and rows[1]["undone_at"] == "t1"
    assert [o["type"] for o in rows[0]["operations"]] == ["TRASH", "GPS"]
    assert ledger.ledger_flatten(ledger.stored_sessions(spark, at)).count() == 6


def test_two_writers_of_a_geocode_cache(spark, tmp_path):
    at = f"{tmp_path}/cache"
    found = lambda who, ks: spark.createDataFrame([(f"{k}.00,0.00", who) for k in ks], metadata.CACHE_SCHEMA)
    assert at_once(lambda: metadata.update_cache(found("a", [1, 2]), at), lambda: metadata.update_cache(found("b", [2, 3]), at)) == []
    got = {r["geo_key"]: r["label"] for r in metadata.load_cache(spark, at).collect()}
    assert got.keys() == {"1.00,0.00", "2.00,0.00", "3.00,0.00"} and got["1.00,0.00"] == "a" and got["3.00,0.00"] == "b"
    assert metadata.load_cache(spark, at, 1).count() == 2


FILES = "path string, hash string"


def arriving(spark, folder, k, rows):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"path": [r[0] for r in rows], "hash": [r[1] for r in rows]}), folder / f"{k}.parquet")
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_restart_in_mid_batch_gives_no_second_copy(spark, tmp_path, monkeypatch):
    index, checkpoint = f"{tmp_path}/index", f"{tmp_path}/checkpoint"
    streams.add_known(spark.createDataFrame([("/old1", "h1"), ("/old2", "h1"), ("/old3", "h2")], FILES), index, "hash")
    run = lambda stream, name="s": streams.dedup_against(stream, index, "hash", checkpoint + name, name)
    stream = arriving(spark, tmp_path / "in", 0, [("/a", "h1"), ("/b", "h3"), ("/c", "h3"), ("/d", "h4")])
    real, fail = streams.dedup_batch, {"after"}

    def dying(*a):
        version = real(*a)
        if fail:
            fail.clear()
            raise RuntimeError("the driver died after the commit, before the checkpoint")
        return version

    monkeypatch.setattr(streams, "dedup_batch", dying)
    with pytest.raises(Exception, match="died"):
        run(stream).awaitTermination()
    arriving(spark, tmp_path / "in", 1, [("/e", "h3"), ("/f", "h5"), ("/a", "h1")])
    run(stream).awaitTermination()
    got = sorted((r["hash"], r["path"][1]) for r in streams.arrivals(spark, index, FILES).collect())
    assert [h for h, _ in got] == ["h1", "h2", "h3", "h4", "h5"] and got[0][1] == got[1][1] == "o"
    before = versions.latest(spark, index)
    assert streams.compact(spark, index, FILES) == before + 1 and len(versions.manifest(spark, index, before + 1)["folders"]) == 1
    other = arriving(spark, tmp_path / "other", 0, [("/g", "h5"), ("/h", "h6")])
    arriving(spark, tmp_path / "in", 2, [("/i", "h6"), ("/j", "h7")])
    assert at_once(lambda: run(stream).awaitTermination(), lambda: run(other, "t").awaitTermination()) == []
    assert sorted(r["hash"] for r in streams.arrivals(spark, index, FILES).collect()) == ["h1", "h2", "h3", "h4", "h5", "h6", "h7"]


def test_three_scans_give_the_catalog_of_a_full_one(spark, tmp_path):
    table = f"{tmp_path}/catalog"
    scan = lambda rows: spark.createDataFrame(rows, "path string, size long, other string").withColumn("mtime", F.timestamp_micros(F.col("size") * 1000 + F.length("other")))
    scans = [[("/a", 1, "x"), ("/b", 2, "x"), ("/c", 3, "x"), (None, 9, "x"), ("/a", 1, "x")], [("/a", 1, "x"), ("/b", 5, "x"), ("/d", 4, "x")], [("/a", 1, "xy"), ("/b", 5, "x"), ("/c", 3, "x")]]
    kinds = []
    for k, rows in enumerate(scans):
        assert streams.capture(scan(rows), table) == k + 1
        got = versions.read(spark, table, streams.CHANGES).where(F.col("at") == k + 1)
        kinds.append(sorted((r["path"], r["kind"]) for r in got.collect()))
        key = lambda df: sorted(map(tuple, df.select("path", "size", "mtime").where("path is not null").distinct().collect()))
        assert key(streams.current(versions.read(spark, table, streams.CHANGES))) == key(scan(rows))
    assert kinds == [[("/a", "added"), ("/b", "added"), ("/c", "added")], [("/b", "changed"), ("/c", "deleted"), ("/d", "added")], [("/a", "changed"), ("/c", "added"), ("/d", "deleted")]]
    # A batch of a stream tells of what is new only, and counts once.
    assert streams.capture(scan([("/e", 7, "x")]), table, whole=False, writer="s", turn=0) == 4 and streams.capture(scan([("/e", 8, "x")]), table, whole=False, writer="s", turn=0) == 0
    streams.fold(spark, table)
    assert versions.read(spark, table, streams.CHANGES).count() == 4 == streams.current(versions.read(spark, table, streams.CHANGES)).count()
