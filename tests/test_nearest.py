"""Nearest places against all pairs, where places crowd, near the poles and across the date line."""

import random

import numpy as np
import pytest

from contactsheet.operators import geo

PLACES = "place_id long, lat double, lon double, city string, town string, county string, state string, country string, country_code string"


def plain(keys, places, limit):
    lat, lon = np.radians([p[1] for p in places]), np.radians([p[2] for p in places])
    out = {}
    for k in keys:
        a, b = map(np.radians, map(float, k.split(",")))
        h = np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2
        d = 2 * 6371000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        best = min(range(len(places)), key=lambda i: (round(d[i], 6), places[i][0]))
        out[k] = f"C_{places[best][0]}" if d[best] <= limit else "Unknown"
    return out


def rows(spots):
    return [(i, lat, lon, str(i), None, None, None, "C", "cc") for i, (lat, lon) in enumerate(spots)]


@pytest.mark.parametrize("leaf", [2, 64])
def test_equal_to_all_pairs(spark, leaf):
    rng = random.Random(3)
    spots = [(rng.uniform(47, 49), rng.uniform(8, 11)) for _ in range(500)] + [(48 + rng.random() * 0.01, 9 + rng.random() * 0.01) for _ in range(1500)]
    spots += [(48.001, 9.001)] * 50 + [(rng.uniform(86, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(rng.uniform(-2, 2), rng.choice([-1, 1]) * rng.uniform(178, 180)) for _ in range(80)] + [(-90.0, 5.0), (90.0, 0.0), (0.0, 180.0), (0.5, -180.0)]
    places = rows(spots)
    keys = {f"{rng.uniform(46.5, 49.5):.2f},{rng.uniform(7.5, 11.5):.2f}" for _ in range(120)} | {f"{48 + rng.random() * 0.03:.2f},{9 + rng.random() * 0.03:.2f}" for _ in range(20)}
    keys |= {f"{rng.uniform(85.5, 90):.2f},{rng.uniform(-180, 180):.2f}" for _ in range(40)} | {f"{rng.uniform(-2.5, 2.5):.2f},{rng.choice([-1, 1]) * rng.uniform(177.5, 180):.2f}" for _ in range(60)} | {"-90.00,100.00", "90.00,0.00", "0.00,-180.00", "10.00,10.00"}
    df = spark.createDataFrame([(k,) for k in keys], "geo_key string")
    got = {r["geo_key"]: r["label"] for r in geo.nearest_place(df, spark.createDataFrame([*places, (10**6, None, 9.0, "none", None, None, None, "C", "cc")], PLACES), leaf=leaf).collect()}
    assert got == plain(keys, places, 50_000.0)


def test_no_places_and_no_keys(spark):
    df = spark.createDataFrame([("1.00,2.00",)], "geo_key string")
    none = spark.createDataFrame([], PLACES)
    assert [r["label"] for r in geo.nearest_place(df, none).collect()] == ["Unknown"]
    assert geo.nearest_place(df.limit(0), none).count() == 0
