"""Large files of a release."""

import hashlib
import sqlite3
import zipfile

import pytest

from attesta.sources import files, streams


def test_a_file_of_more_than_two_gigabytes_is_digested(spark, tmp_path):
    size = 2_500_000_000
    with (tmp_path / "large é.bin").open("wb") as f:
        f.truncate(size)  # sparse
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "small").write_bytes(b"abc")
    want, zero = hashlib.sha256(), bytes(streams.CHUNK)
    for at in range(0, size, len(zero)):
        want.update(zero[: min(len(zero), size - at)])
    out = {r.path.rpartition("/")[2]: (r.size_bytes, r.sha256) for r in files.manifest(spark, str(tmp_path)).collect()}
    assert out == {"large é.bin": (size, want.hexdigest()), "small": (3, hashlib.sha256(b"abc").hexdigest())}


def test_sqlite_is_read_in_ranges_of_row_ids(spark, tmp_path):
    path = str(tmp_path / "a b.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i % 7 == 0 else f"é{i}") for i in range(12_345)])
    db.execute("DELETE FROM t WHERE a % 5 = 0")
    db.execute("CREATE TABLE bare (k TEXT PRIMARY KEY) WITHOUT ROWID")
    db.execute("INSERT INTO bare VALUES ('x'), ('y')")
    db.execute("CREATE VIEW v AS SELECT a FROM t WHERE a < 4")
    db.execute("CREATE TABLE empty (a)")
    db.commit()
    db.close()
    out = files.sqlite_table(spark, path, "t", ["a", "b"], ("bare",))
    assert out.rdd.getNumPartitions() == 8
    assert sorted((int(r.a), r.b) for r in out.collect()) == [(i, None if i % 7 == 0 else f"é{i}") for i in range(12_345) if i % 5]
    assert sorted(r.k for r in files.sqlite_table(spark, path, "bare", ["k"]).collect()) == ["x", "y"]
    assert sorted(r.a for r in files.sqlite_table(spark, f"file:{path}", "v", ["a"]).collect()) == ["1", "2", "3"]
    assert files.sqlite_table(spark, path, "empty", ["a"]).collect() == []
    with pytest.raises(Exception, match="tables are missing: gone"):
        files.sqlite_table(spark, path, "t", ["a"], ("gone",)).collect()


def test_members_of_archives_are_streamed(spark, tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("products.txt", "a~b\n" + "".join(f"{n}~{i}\n" for i in range(7000)))
    out = files.zip_table(spark, str(tmp_path), "products.txt", ["a", "b"], "~")
    assert out.rdd.getNumPartitions() == 3
    assert sorted((r.a, int(r.b), r.seq) for r in out.collect()) == [(str(n), i, i) for n in range(3) for i in range(7000)]
    assert files.manifest(spark, str(tmp_path)).count() == 3


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"abc")
    monkeypatch.setattr(streams, "_opens", lambda uri: False)
    assert files.manifest(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert not streams.local("s3a://bucket/x") and streams.local("file:///a/b") == "/a/b" == streams.local("file:/a/b")
