"""Listing trees on executors against a plain walk, and duplicates that open only files which may have a copy."""

import hashlib
import os
import random

import pytest

from contactsheet.operators import dedup
from contactsheet.sources import images, metadata, store, walk

LISTING = "file_id long, path string, size long"


def plain(base):
    """path: size of all regular files below a folder; links to folders aren't entered."""
    out = {}
    for folder, _, names in os.walk(base):
        for n in names:
            path = os.path.join(folder, n)
            if os.path.isfile(path):
                out[path] = os.stat(path).st_size
    return out


def grown(rng, base, folders, files):
    at = [str(base)]
    for i in range(folders):
        at.append(f"{rng.choice(at[-40:])}/{rng.choice(['d', '.h', '_u', 'ü '])}{i}")
        os.mkdir(at[-1])
    for i in range(files):
        with open(f"{rng.choice(at)}/f{i}{rng.choice(['.jpg', '.JPG', '.txt', ''])}", "wb") as f:
            f.write(b"x" * rng.randrange(4))


@pytest.mark.parametrize("budgets", [{}, {"most_seen": 7, "most_looked_up": 3, "items": 2}])
def test_tree_equals_a_plain_walk(spark, tmp_path, budgets):
    grown(random.Random(5), tmp_path, 150, 1200)
    (tmp_path / "flat").mkdir()
    for i in range(300):
        (tmp_path / "flat" / f"{i}.png").touch()
    got = walk.walk(spark, str(tmp_path), **budgets).collect()
    assert len(got) == len({r["path"] for r in got}) and {r["kind"] for r in got} == {"file"}
    assert {r["path"]: r["size"] for r in got} == plain(tmp_path)
    assert all(abs(r["mtime"].timestamp() - os.stat(r["path"]).st_mtime) < 1e-3 for r in got[:50])
    listed = metadata.listed(walk.walk(spark, f"file://{tmp_path}"), ("JPG", ".png")).collect()
    want = [p for p in plain(tmp_path) if p.lower().endswith((".jpg", ".png"))]
    assert sorted(r["path"] for r in listed) == sorted(want) and {r["extension"] for r in listed} == {".jpg", ".png"}


def test_a_chain_of_folders_takes_rounds(spark, tmp_path):
    at = tmp_path
    for i in range(60):
        at = at / f"d{i}"
        at.mkdir()
        (at / "f.jpg").touch()
    assert walk.walk(spark, str(tmp_path), most_seen=10).count() == 60


def test_links_special_files_and_odd_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"abc")
    (tmp_path / "in" / ".b.jpg").write_bytes(b"")
    os.symlink(tmp_path / "in" / "a.jpg", tmp_path / "link.jpg")
    os.symlink(tmp_path, tmp_path / "in" / "cycle")
    os.symlink(tmp_path / "none", tmp_path / "broken.jpg")
    os.mkfifo(tmp_path / "pipe.jpg")
    (tmp_path / "folder.jpg").mkdir()
    os.close(os.open(os.path.join(os.fsencode(str(tmp_path)), b"\xff.jpg"), os.O_CREAT))
    got = walk.walk(spark, str(tmp_path))
    assert {(r["path"], r["size"]) for r in got.where("kind = 'file'").collect()} == {(f"{tmp_path}/in/a.jpg", 3), (f"{tmp_path}/in/.b.jpg", 0), (f"{tmp_path}/link.jpg", 3)}
    assert [r["error"] for r in walk.problems(got).collect()] == ["the name isn't UTF-8"]
    assert sorted(r["filename"] for r in metadata.listed(got, (".jpg",)).collect()) == ["a.jpg", "link.jpg"]
    missing = walk.walk(spark, f"{tmp_path}/nowhere").collect()
    assert [(r["kind"], r["path"]) for r in missing] == [("error", f"{tmp_path}/nowhere")]
    assert metadata.scan_files(spark, f"{tmp_path}/nowhere", (".jpg",)).count() == 0


def test_a_folder_that_cannot_be_read_is_an_error(monkeypatch, tmp_path):
    (tmp_path / "locked").mkdir()
    (tmp_path / "a.jpg").touch()
    known = store.entries
    monkeypatch.setattr(store, "entries", lambda f: known(f) if not f.endswith("locked") else (_ for _ in ()).throw(PermissionError("locked")))
    rows = list(walk._visit("folder", str(tmp_path), 100, 100))
    assert sorted((r[0], os.path.basename(r[1])) for r in rows) == [("error", "locked"), ("file", "a.jpg")]
    assert [r[0] for r in walk._visit("unseen", f"{tmp_path}/gone.jpg", 1, 1)] == ["error"]


def test_uris_go_through_arrow(tmp_path):
    (tmp_path / "d").mkdir()
    store.put(f"{tmp_path}/d/a.bin", b"12345")
    from pyarrow import fs

    class Mock:
        def __init__(self):
            self.inner = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.inner, name)

    real, store._remote = store._remote, lambda uri: (Mock(), uri.split("://")[1])
    try:
        assert list(store.entries(f"mem://{tmp_path}")) == [("folder", f"mem://{tmp_path}/d")]
        assert store.size_and_time(f"mem://{tmp_path}/d/a.bin")[0] == 5
        with store.opened(f"mem://{tmp_path}/d/a.bin") as f:
            assert f.read(9) == b"12345"
        store.put(f"mem://{tmp_path}/e/b.bin", b"1")
        assert os.path.getsize(f"{tmp_path}/e/b.bin") == 1
        with pytest.raises(FileNotFoundError):
            store.size_and_time(f"mem://{tmp_path}/none")
    finally:
        store._remote = real


def made(tmp_path):
    """Files whose names say whether they have a copy, are alike at the ends only, share a size, or neither."""
    end, middle, rng = b"e" * dedup.ENDS, b"m" * 5000, random.Random(1)
    files = {f"copy{i}": end + middle + end for i in range(3)} | {f"ends{i}": end + bytes([65 + i]) * 5000 + end for i in range(2)}
    files |= {f"size{i}": rng.randbytes(20_001) for i in range(4)} | {f"alone{i}": b"z" * (30_000 + i) for i in range(5)}
    files |= {"small0": b"abc", "small1": b"abc", "small2": b"abd", "empty0": b"", "empty1": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return files


def test_duplicates_read_what_may_have_a_copy(spark, tmp_path):
    files = made(tmp_path)
    rows = [(i, f"{tmp_path}/{n}", len(d)) for i, (n, d) in enumerate(files.items())]
    ends, whole = dedup.file_hashes(spark.createDataFrame(rows, LISTING))
    kind = lambda p: os.path.basename(p).rstrip("0123456789")
    first = {(kind(r["path"]), r["read_bytes"]) for r in ends.collect()}
    assert first == {("copy", 2 * dedup.ENDS), ("ends", 2 * dedup.ENDS), ("size", 2 * dedup.ENDS), ("small", 3)}
    again = [(kind(r["path"]), r["read_bytes"]) for r in whole.collect()]
    # `ends` are as long as `copy` and alike at both ends, so only these two kinds were read whole.
    assert sorted(again) == [("copy", len(files["copy0"]))] * 3 + [("ends", len(files["ends0"]))] * 2 + [("small", 3)] * 2
    got = {(r["path"], r["hash"], r["count"]) for r in dedup.file_duplicates(spark.createDataFrame(rows, LISTING)).collect()}
    md5 = lambda n: hashlib.md5(files[n]).hexdigest()
    assert got == {(f"{tmp_path}/{n}", md5(n), 3 if n < "d" else 2) for n in ("copy0", "copy1", "copy2", "small0", "small1")}


def test_duplicates_of_sparse_files_without_reading_them(spark, tmp_path):
    """Terabytes that would never be read in time: only their ends are."""
    rows = []
    for i, size in enumerate([1 << 40, 1 << 40, (1 << 40) + 1]):
        path = tmp_path / f"{i}.mov"
        with open(path, "wb") as f:
            f.truncate(size)
            f.seek(size - 1)
            f.write(bytes([i]))
        rows.append((i, str(path), size))
    assert dedup.file_duplicates(spark.createDataFrame(rows, LISTING)).count() == 0


def test_files_that_changed_or_went_away_have_no_copies(spark, tmp_path):
    for n in "abcd":
        (tmp_path / n).write_bytes(b"12345")
    rows = [(0, f"{tmp_path}/a", 5), (1, f"{tmp_path}/b", 5), (2, f"{tmp_path}/gone", 5), (3, f"{tmp_path}/c", 7), (4, f"{tmp_path}/d", 7), (None, None, None)]
    got = dedup.file_duplicates(spark.createDataFrame(rows, LISTING)).collect()
    assert sorted(r["file_id"] for r in got) == [0, 1]
    ends = dedup.file_hashes(spark.createDataFrame(rows, LISTING))[0]
    assert sorted(r["file_id"] for r in ends.where("error is not null").collect()) == [2, 3, 4]
    assert dedup.file_duplicates(spark.createDataFrame([], LISTING)).count() == 0


def test_pictures_are_read_in_shares(spark, tmp_path):
    from tests.test_sources import png
    import numpy as np

    rng = np.random.default_rng(0)
    for i in range(7):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        png(tmp_path / f"d{i % 3}" / f"{i}.png", rng.integers(0, 255, (40, 40, 3)))
    (tmp_path / "bad.png").write_bytes(b"none")
    (tmp_path / "note.txt").write_bytes(b"none")
    all_at_once = sorted(map(tuple, images.read_images(spark, str(tmp_path), images.hashed_images).collect()))
    assert len(all_at_once) == 7 and all_at_once == sorted(map(tuple, images.read_images(spark, str(tmp_path), images.hashed_images, at_once=2).collect()))
    assert images.read_images(spark, f"{tmp_path}/none").count() == 0
