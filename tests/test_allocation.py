"""Names given in the order of claims, against a plain loop."""

import random

import pytest

from contactsheet.plans import plan

CLAIMS = "file_id long, path string, dest_dir string, name string"


def plain(claims, existing, most=None):
    taken, out = set(existing), {}
    for i, path, folder, name in sorted(claims):
        full = f"{folder}/{name}"
        if path == full:
            out[i] = full
            continue
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem and ext else (name, "")
        if full in taken:
            full = next((t for n in range(1, (most or 10**6) + 1) if (t := f"{folder}/{stem}_{n}{ext}") not in taken), None)
        out[i] = full
        taken.add(full)
    return out


@pytest.mark.parametrize("most", [None, 3])
def test_serving_in_order(spark, most):
    rng = random.Random(6)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "a_3_1.jpg", "b.jpg", "b_1", "b", "c_01.jpg", "d_5.jpg", "a_1.png", ".x", "x_1.jpg"]
    claims = [(i, f"/in/{i}", rng.choice(["/d", "/e"]), rng.choice(names)) for i in rng.sample(range(1000), 260)]
    claims += [(5000, "/d/a.jpg", "/d", "a.jpg"), (5001, "/in/z", "/f", "z.jpg")]
    existing = ["/d/a.jpg", "/d/a_4.jpg", "/e/a_1_2.jpg", "/e/b_2.jpg", "/d/q.jpg", "/e/a_1.jpg", "/e/x.jpg"]
    df, there = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame([(p,) for p in existing], "path string")
    got = {r["file_id"]: r["target"] for r in plan.allocate_targets(df, there, most, ref_compat=True).collect()}
    assert got == plain(claims, existing, most)
    made = [t for t in got.values() if t]
    assert len(made) == len(set(made)) and plan.allocate_targets(df.limit(0), there, ref_compat=True).count() == 0
