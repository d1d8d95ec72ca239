"""Content hashes of any file, and publishing whole or not at all."""

import hashlib
import os
import tracemalloc

import pytest

from lodestrata.sources import hashing, publish


def test_hashes_are_those_of_the_files(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    data = {"a/one.bin": os.urandom(100), "a/deep/two.bin": b"", "a/three.txt": b"x" * (hashing.PIECE + 5), "a/_hidden": b"no", "a/deep/.crc": b"no"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    want = {str(tmp_path / n): (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items() if "no" != c.decode("latin1")}
    for path in (f"{tmp_path}/a", f"file:{tmp_path}/a/"):
        assert {r.path: (r.bytes, r.sha256) for r in hashing.content_hashes(spark, path).collect()} == want
    some = hashing.content_hashes(spark, f"{tmp_path}/a/*.bin").collect()
    assert [r.path for r in some] == [f"{tmp_path}/a/one.bin"]
    (tmp_path / "empty").mkdir()
    assert hashing.content_hashes(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="missing"):
        hashing.content_hashes(spark, f"{tmp_path}/missing").collect()


def test_a_file_of_three_gigabytes_takes_little_memory(tmp_path):
    size = 3 << 30
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    reader = hashing.ContentHashReader(str(tmp_path / "large"))
    tracemalloc.start()
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    h = hashlib.sha256()
    for _ in range(size >> 24):
        h.update(bytes(1 << 24))
    assert rows == [(str(tmp_path / "large"), size, h.hexdigest())] and peak < 200 << 20


def test_published_whole_or_not_at_all(spark, tmp_path):
    target, df = f"{tmp_path}/out", spark.range(10)
    assert publish.publish(spark, {"t": df, "u": df.limit(3)}, target, "c")["counts"] == {"t": 10, "u": 3}
    assert publish.published(spark, target, "u").count() == 3 and publish.damaged(spark, target).isEmpty()
    with pytest.raises(publish.InUse, match="published already"):
        publish.publish(spark, {"t": df}, target, "c")
    assert sorted(os.listdir(tmp_path)) == ["out"]
    file = next(f for f in (tmp_path / "out" / "t").iterdir() if f.suffix == ".parquet")
    file.write_bytes(file.read_bytes() + b"!")
    assert [r.file for r in publish.damaged(spark, target).collect()] == [f"t/{file.name}"]


def test_two_writers_and_a_killed_one(spark, tmp_path):
    target, df, seen = f"{tmp_path}/out", spark.range(5), []

    class Second(dict):
        """Tables of the first writer; a second one tries while the first is at work."""

        def items(self):
            with pytest.raises(publish.InUse, match="at work"):
                publish.publish(spark, {"t": df}, target, "c")
            seen.append(1)
            return super().items()

    publish.publish(spark, Second(t=df), target, "c")
    assert seen and publish.published(spark, target, "t").count() == 5

    class Killed(BaseException):
        pass

    class Dies(dict):
        def items(self):
            yield "t", df
            raise Killed

    other, removed = f"{tmp_path}/other", publish._Folder.remove
    publish._Folder.remove = lambda self, p: None  # a dead process clears nothing away
    try:
        with pytest.raises(Killed):
            publish.publish(spark, Dies(), other, "c")
    finally:
        publish._Folder.remove = removed
    left = [n for n in os.listdir(tmp_path) if n.startswith("other.staging")]
    assert left and not os.path.exists(other)
    with pytest.raises(publish.InUse, match="at work"):
        publish.publish(spark, {"t": df}, other, "c")
    publish.publish(spark, {"t": df}, other, "c", lease=-1)
    assert publish.published(spark, other, "t").count() == 5 and sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["other", "out"]


def test_a_writer_that_outlived_its_claim_does_not_publish(spark, tmp_path):
    target, df = f"{tmp_path}/out", spark.range(5)

    class Slow(dict):
        def items(self):
            yield "t", df
            publish.publish(spark, {"t": df.limit(2)}, target, "later", lease=-1)

    with pytest.raises(Exception):  # noqa: B017  its folder or its claim is gone
        publish.publish(spark, Slow(), target, "c")
    assert publish.published(spark, target, "t").count() == 2
