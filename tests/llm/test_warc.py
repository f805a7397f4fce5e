import hashlib
import random
import struct

import pytest
import zstandard

from sitelens.llm import warc


def test_archive_round_trip_and_damage():
    records = [warc.record(1, "http://a/\r\nx: y", b"<p>" * 40), warc.record(2, None, b""), warc.record(3, "http://b", None, 7, 120, hashlib.sha1(b"<p>" * 40).hexdigest())]
    for raw in (b"", warc.dictionary(records), warc.dictionary([b"page %d " % k * 50 for k in range(40)])):
        data = warc.archive(records, raw)
        assert list(warc.read_archive(data)) == records
        for k in (len(data) // 2, len(data) - 3):
            with pytest.raises(ValueError):
                [warc.parse(r) for r in warc.read_archive(data[:k])]
        flipped = bytearray(data)
        flipped[-6] ^= 255
        with pytest.raises(ValueError):
            [warc.parse(r) for r in warc.read_archive(bytes(flipped))]
    raw = warc.dictionary([b"page %d " % k * 50 for k in range(40)])
    packed = zstandard.compress(raw)
    frames = warc.archive(records, raw)[8 + len(raw) :]
    assert list(warc.read_archive(struct.pack("<II", warc.MAGIC, len(packed)) + packed + frames)) == records
    p = warc.parse(records[2])
    assert p["payload_digest"] == warc.digest(b"<p>" * 40)
    assert (p["record_type"], p["refers_to"], p["payload_bytes"], p["payload"]) == ("revisit", "7", 120, b"")
    for bad in (records[0].replace(b"WARC/1.1", b"WARC/0.9"), records[0] + b"x", records[0].replace(b"<p>", b"<q>", 1), records[0].replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_frames(spark, tmp_path):
    rows = [(1, "http://a", "same", "q"), (2, None, "same", "q"), (3, "http://c", None, "q"), (4, "http://d", "", "q"), (5, "http://e", "é" * 90_000, "q"), (2, None, "same", "q"), (None, "http://f", "same", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    archives = warc.write_archives(df, most=50)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect())
    d = lambda t: warc.digest(t.encode())
    assert got == sorted([("1", 4, d("same"), "revisit", "2"), ("2", 4, d("same"), "response", None), ("2", 4, d("same"), "response", None), ("3", 0, d(""), "revisit", "4"), ("4", 0, d(""), "response", None), ("5", 180_000, d("é" * 90_000), "response", None), ("None", 4, d("same"), "revisit", "2")], key=lambda x: (x[0], x[3]))
    assert all(r["record_type"] == "response" for r in warc.read_archives(warc.write_archives(df, revisit_from=10**6)).collect())
    warc.export_archives(archives, f"file://{tmp_path}")
    files = list(tmp_path.glob("*.warc.zst"))
    assert len(files) == archives.count() and all(hashlib.sha1(f.read_bytes()).hexdigest() in f.name for f in files)
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_many_copies_and_a_very_long_page(spark):
    r = random.Random(3)
    rows = [(k, f"http://h/{k}", r.choice(["", "copied everywhere", "twice", f"own {k}"])) for k in range(2000)]
    rows += [(9000, "http://long", "x" * 3_000_000), (9001, "http://long", "x" * 3_000_000), (None, "http://n", "twice"), (None, "http://n", "alone"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    best = {}
    for k, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if k is None else k)
    want = sorted((str(k), len(html or ""), "response" if (best[html or ""] in (k, -1)) else "revisit", None if best[html or ""] in (k, -1) else str(best[html or ""])) for k, _, html in rows)
    got = [(x["page_id"], x["payload_bytes"], x["record_type"], x["refers_to"]) for x in warc.read_archives(warc.write_archives(df)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
