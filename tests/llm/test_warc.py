import gzip
import hashlib

from pyspark.sql import functions as F

from lodestrata.llm import warc as W

BIG = "<p>" + "payload " * 40 + "é</p>"
ROWS = [(5, "http://a/\r\nx", BIG), (3, "http://b/", BIG), (9, None, BIG), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (3, "http://b/", BIG), (None, "n", BIG), (10, "v", "y" * 300_000)]


def brute(rows):
    out = []
    for k, _, html in rows:
        p = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        first = min(same) if len(p) >= 100 and same else k
        revisit = k != first
        out.append((k, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(repr, out))


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark):
    assert sorted(repr(tuple(r)) for r in W.round_trip(pages(spark)).collect()) == brute(ROWS)
    assert W.round_trip(pages(spark, [])).count() == 0


def test_payloads_and_pushed_filters(spark):
    path = W.archive(pages(spark))
    all_ = W.load(spark, path)
    payloads = {r.page_id: bytes(r.payload).decode() for r in all_.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert payloads[3] == BIG and payloads[10] == "y" * 300_000 and payloads[7] == ""
    assert all_.where(F.col("page_id").isin(4, 10)).count() == 2
    assert all_.where("record_type = 'revisit' AND refers_to = 3").count() == 3
    assert all_.where("target_uri = 'http://b/' AND payload_bytes > 5").count() == 2
    reader = W.WarcReader({"path": path})
    left = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", ("revisit",))]
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert {x["record_type"] for x in got} == {"revisit"} and len(got) == 3


def test_foreign_archives(spark, tmp_path):
    records = [W.record("response", i, f"http://x/{i}", b"body %d" % i * (50_000 if i == 1 else 1), "d", 0, None, "2020-01-01T00:00:00Z") for i in range(4)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    df = W.load(spark, str(tmp_path))
    assert df.count() == 8 and df.where("page_id = 2").count() == 2
    assert {bytes(r.payload) for r in df.where("page_id = 3").collect()} == {b"body 3"}
    assert df.where("page_id = 1").agg(F.min("payload_bytes")).first()[0] == 300_000


def test_files_without_a_manifest_entry_are_not_read(spark):
    path = W.archive(pages(spark))
    fs, root = W._store(path)
    with fs.open_output_stream(f"{root}/stray.warc") as f:
        f.write(W.record("response", 77, None, b"", "d", 0, None, "2020-01-01T00:00:00Z"))
    assert W.load(spark, path).count() == len(ROWS)


def test_files_roll(spark):
    path = W.shared_dir(spark)
    W.deduplicated(pages(spark)).coalesce(1).write.format("warc").option("maxFileBytes", "1").mode("append").save(path)
    assert W.load(spark, path).count() == len(ROWS)


def records(n, kind="response"):
    return [W.record(kind, i, f"http://x/{i}", b"body %d" % i * (50_000 if i == 1 else 1), "d", 0, None, "2020-01-01T00:00:00Z") for i in range(n)]


def test_members_of_several_records(spark, tmp_path):
    found = records(6)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(found)))
    (tmp_path / "mixed.warc.gz").write_bytes(W.member(b"".join(found[:3]), 3) + gzip.compress(found[3]) + W.member(found[4], 3) + W.member(found[5], 3) + b"\0" * 64)
    df = W.load(spark, str(tmp_path))
    assert sorted((r.page_id, r.payload_bytes) for r in df.collect()) == sorted(2 * [(i, 300_000 if i == 1 else 6) for i in range(6)])
    for wanted in range(6):
        assert df.where(F.col("page_id") == wanted).count() == 2


def test_broken_records(spark, tmp_path):
    a, b, c = records(3)
    broken = b.replace(b"Content-Length: 3000", b"Content-Length: many 3000")
    (tmp_path / "broken.warc").write_bytes(a + broken + c)
    (tmp_path / "broken.warc.gz").write_bytes(gzip.compress(a + broken + c) + gzip.compress(c)[:60])
    got = W.load(spark, str(tmp_path)).select("page_id", "payload_bytes").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got if r.page_id != 1) == [(0, 6), (0, 6), (2, 6), (2, 6)]
    assert {r.payload_bytes for r in got if r.page_id == 1} == {0}


def test_padding_and_damage_between_members(spark, tmp_path):
    a, b, c = map(gzip.compress, records(3))
    hurt = bytearray(b)
    hurt[len(b) // 2 : len(b) // 2 + 8] = bytes(255 - x for x in hurt[len(b) // 2 : len(b) // 2 + 8])
    (tmp_path / "padded.warc.gz").write_bytes(a + b"\0" * 700_000 + b + b"\0" * 5 + c + b"\0")
    (tmp_path / "hurt.warc.gz").write_bytes(a + bytes(hurt) + c)
    df = W.load(spark, str(tmp_path))
    got = df.select("page_id", "record_type", "payload_bytes").collect()
    assert sorted(r.page_id for r in got if r.record_type == "response") == [0, 0, 1, 2, 2]
    lost = df.where("record_type = 'damaged'").collect()
    assert [r.record_id for r in lost] == [f"{tmp_path}/hurt.warc.gz#{len(a)}"] and df.where("page_id = 2").count() == 2
    last = bytearray(c)
    last[10] = 0x07  # a block of a kind that there is none of
    (tmp_path / "last").mkdir()
    (tmp_path / "last" / "last.warc.gz").write_bytes(a + bytes(last))
    assert sorted(r.record_type for r in W.load(spark, f"{tmp_path}/last").collect()) == ["damaged", "response"]


def test_commits_side_by_side_and_aborts(spark, tmp_path):
    one, two = (W.WarcWriter({"path": str(tmp_path)}, False) for _ in range(2))
    batch = spark.createDataFrame([("response", None, "u", 1, None, 2, "d", b"ab")], W.SCHEMA).toArrow().to_batches()
    first, second, third = one.write(iter(batch)), two.write(iter(batch)), two.write(iter(batch))
    one.commit([first])
    two.commit([second, None])
    two.abort([third])
    assert W.load(spark, str(tmp_path)).count() == 2 and len(list(tmp_path.glob("*.warc.gz"))) == 2
    W.WarcWriter({"path": str(tmp_path)}, True).commit([first])
    assert W.load(spark, str(tmp_path)).count() == 1


def test_no_payload_is_shuffled(spark):
    plan = W.deduplicated(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
