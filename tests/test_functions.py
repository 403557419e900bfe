"""Edge values of the column functions."""

import pytest
from pyspark.sql import functions as F

from contactsheet.functions import exprs as X
from contactsheet.operators import dates


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).head()["r"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024:01:05 03:04:05", 1704423845.0), ("2024-01-05T03:04:05", 1704423845.0), ("2024-01-05 03:04:05", 1704423845.0), ("2024:01:05 03:04:05+08:00", None), ("bad", None), ("2024:02:31 00:00:00", None), (None, None)],
)
def test_exif_seconds(spark, text, want):
    assert one(spark, "string", text, lambda v: X.exif_seconds(v, F.lit(None).cast("double"))) == want


@pytest.mark.parametrize(("name", "want"), [("IMG_20240101_120000.jpg", 1704110400.0), ("2024-01-01_12-00-00.png", 1704110400.0), ("20240101120000", None), ("20240101_120060", None), ("20240231_120000", None)])
def test_name_seconds(spark, name, want):
    assert one(spark, "string", name, X.name_seconds) == want


@pytest.mark.parametrize(("text", "want"), [("2019:11:30 08:09:10+02:00", "20191130_080910"), ("2019:11:30 08:09:10-09:30", "20191130_080910"), ("2019-11-30T08:09:10", None), ("2019:99:99 08:09:10 x", "20199999_080910"), (None, None)])
def test_date_name(spark, text, want):
    assert one(spark, "string", text, X.date_name) == want


def test_zoned_date(spark):
    text = "2018:07:04 21:15:42-05:00"
    assert one(spark, "string", text, X.utc_seconds) - one(spark, "string", text, X.local_seconds) == 5 * 3600
    assert one(spark, "string", "2018:07:04 21:15:42", X.utc_seconds) is None


@pytest.mark.parametrize(("text", "local", "utc"), [("1970-01-02T00:00:01.25+0130", 86401.0, 81001.0), (" 1970:01:01 00:00:09 ", 9.0, None), ("1970:01:01 24:00:00", None, None), ("1970:02:30 00:00:00Z", None, None), (None, None, None)])
def test_clock_and_instant(spark, text, local, utc):
    assert (one(spark, "string", text, X.local_seconds), one(spark, "string", text, X.utc_seconds)) == (local, utc)


@pytest.mark.parametrize(("text", "want"), [("1.5,-2.5", (1.5, -2.5)), (" +10 , .5 ", (10.0, 0.5)), ("91,0", None), ("1;2", None), ("", None), ("1,2,3", None), (None, None)])
def test_parse_gps(spark, text, want):
    got = one(spark, "string", text, X.parse_gps)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("value", "want"), [(44, 0), (45, 0), (46, 90), (350, 270)])
def test_snap_rotation(spark, value, want):
    assert one(spark, "int", value, X.snap_rotation) == want


@pytest.mark.parametrize(("name", "want"), [("20240101_120000.jpg", True), ("20240101_120000_2.jpg", True), ("20240101_120000-1.jpg", False)])
def test_date_named(spark, name, want):
    assert one(spark, "string", name, dates.is_date_named) is want


@pytest.mark.parametrize(("name", "want"), [("a.b.JPG", ".JPG"), (".hidden", ""), ("none", ""), (".a.b", ".b")])
def test_suffix(spark, name, want):
    assert one(spark, "string", name, X.suffix) == want
