import hashlib

import pytest

from quillon.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, header string"
LONG = "é" * 60
ROWS = [(3, "http://a/", LONG, "x", "y"), (1, "http://b/\r\nWARC-Type: x", LONG, None, None), (2, None, "short", None, None), (4, "u", "short", None, None), (5, "u", None, None, None), (6, "u", "", None, None), (1, "again", LONG, None, None), (None, "n", LONG, None, None), (7, "u", "z" * 100_000, None, None)]


def test_round_trip(spark):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(ROWS, SCHEMA)).collect())
    want = []
    for page, _, html, *_ in ROWS:
        data = (html or "").encode()
        again = len(data) >= 100 and html == LONG and page != 1
        want.append((str(page), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=lambda r: r[:4])
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_are_exact(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "w"))
    records = {(r.page_id, len(r.record)): bytes(r.record) for r in warc.records(spark, str(tmp_path / "w")).collect()}
    for record in records.values():
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(lines[b"Content-Length"]) == len(rest) - 4
        if lines[b"WARC-Type"] == b"response":
            assert lines[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(rest[:-4]).hexdigest().encode()
    assert len(spark.read.parquet(str(tmp_path / "w/payloads")).collect()) == 4  # equal payloads once
    warc.export(spark, str(tmp_path / "w"), str(tmp_path / "out"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


def test_damage_is_seen(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS[:1], SCHEMA), str(tmp_path / "w"))
    spark.createDataFrame([(hashlib.sha256(LONG.encode()).hexdigest(), b"other")], "digest string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, str(tmp_path / "w")).collect()
