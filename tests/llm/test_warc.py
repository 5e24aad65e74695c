from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from kelpline.llm.warc import archive_records, build_record, inflate, normalise, read_record, split_records

SCHEMA = "page_id long, url string, html string, sha string, keeper long"


def test_records_by_brute_force(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 7)}</p>", "x", 1) for i in range(60)] + [(100, None, None, "x", 1), (101, "http://a b\n", "", "x", 1), (None, "u", "only", "x", 1), (102, "big", "y" * 300000, "x", 1)]
    got = {x.page_id: x for x in archive_records(spark.createDataFrame(rows, SCHEMA), archive_bytes=4000).collect()}
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    assert got.keys() == payload.keys()
    for i, x in got.items():
        same = [j for j in payload if payload[j] == payload[i] and j is not None]
        assert (x.payload_bytes, x.payload_digest) == (len(payload[i]), base64.b32encode(hashlib.sha1(payload[i]).digest()).decode())
        if i is not None:
            assert (x.record_type, x.refers_to) == (("response", None) if i == max(same) else ("revisit", max(same)))
    small = {x.page_id: x.record_type for x in archive_records(spark.createDataFrame(rows, SCHEMA), min_bytes=10).collect()}
    assert small[0] == "response" and small[6] == "revisit"


def test_empty_table_and_repeated_rows(spark):
    assert archive_records(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(5, "u", "same", "s", 1), (5, "u", "same", "s", 1), (4, "u", "same", "s", 1)], SCHEMA)
    assert sorted((x.page_id, x.record_type, x.refers_to) for x in archive_records(twice).collect()) == [(4, "revisit", 5), (5, "response", None), (5, "response", None)]
    nobody = spark.createDataFrame([(None, "u", "same", "s", 1), (None, "u", "same", "s", 1), (None, "u", "other", "s", 1), (3, "u", "other", "s", 1)], SCHEMA)
    assert sorted(map(str, ((x.page_id, x.record_type, x.refers_to) for x in archive_records(nobody).collect()))) == ["(3, 'response', None)", "(None, 'response', None)", "(None, 'response', None)", "(None, 'revisit', 3)"]


def test_normaliser_indexes_every_member():
    records = [build_record(i, f"http://x/{i}", b"\r\n\r\n" * i + b"body", "D", i % 2 == 0, 0) for i in range(20)]
    for data in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records), gzip.compress(b"".join(records[:9])) + gzip.compress(b"".join(records[9:]))):
        out, index = normalise(data)
        assert gzip.decompress(out) == b"".join(records) and len(index) == 20
        for i, entry in enumerate(index):
            assert gzip.decompress(out[entry["offset"] : entry["offset"] + entry["length"]]) == records[i]
            warc, http, payload = read_record(out, entry["offset"], entry["length"])
            assert warc["warc-record-id"] == f"<urn:page:{i}>" and payload == (b"\r\n\r\n" * i + b"body" if i % 2 == 0 else b"")
            assert int(http["content-length"]) == 4 * i + 4


def test_pieces_of_any_size_and_broken_archives():
    raw = b"".join(build_record(i, None, b"p" * i, "D", True, None) for i in range(5))
    assert [r for _, r in split_records(raw[k : k + 3] for k in range(0, len(raw), 3))] == [r for _, r in split_records([raw])]
    assert b"".join(inflate(gzip.compress(raw), 7)) == raw
    with pytest.raises(ValueError):
        list(split_records([raw[:-3]]))
    with pytest.raises((ValueError, Exception)):
        normalise(gzip.compress(raw)[:-20])
