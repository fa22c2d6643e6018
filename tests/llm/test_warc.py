import base64
import hashlib
import random
from collections import defaultdict

import pytest

from veilgate.llm import warc as W
from veilgate.session import scratch_path

ROWS = [
    (5, "http://a/5", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://n", "<p>same</p>"),
    (1, "http://a/1\r\nX-Evil: 1 %0A", "é 漢 \r\n\r\n WARC/1.1\r\n"), (3, "u", None), (4, "u", ""), (7, "u", "x"),
    (7, "u", "x"), (7, "v", "x"), (8, "big", "y" * 300_000), (None, None, None),
]


def brute(rows, least=0):
    groups = defaultdict(list)
    for n, (page, url, html) in enumerate(rows):
        groups[html or ""].append((page is None, page or 0, url or "", n))
    out = []
    for html, members in groups.items():
        members.sort()
        first = rows[members[0][3]][0]
        for k, (*_, n) in enumerate(members):
            revisit = k > 0 and len(html.encode()) >= least
            digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
            out.append((rows[n][0], rows[n][1], len(html.encode()), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(W, "FILE_BYTES", 2000)
    rng = random.Random(1)
    rows = ROWS + [(100 + i, f"http://b/{i}", "<html>" + "word " * rng.randint(1, 40) + str(i % 37) + "</html>") for i in range(300)]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, row int, digest string")
    folder = scratch_path(spark, "warc-test")
    files = W.write_archive(frame, folder, least_bytes=least)
    assert files.agg({"records": "sum"}).first()[0] == len(rows) and files.count() > 5
    back = W.read_archive(spark, folder, payload=True).collect()
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got, key=str) == brute(rows, least)
    for r in back:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest)
    assert len({r.record_id for r in back}) == len(rows)


def test_file_layout():
    records = [W.write_record(i, "u", "<p>hello world of pages</p>" * 5 + str(i), f"r{i}", 0, None, None, False) for i in range(400)]
    data = W.pack_file(records)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D and int.from_bytes(data[4:8], "little") > 0
    assert list(W.unpack_file(data)) == records
    assert len(data) < sum(map(len, records)) / 4
    assert list(W.unpack_file(W.pack_file(records[:1]))) == records[:1]
    with pytest.raises(ValueError):
        list(W.unpack_file(data[:-3]))
    with pytest.raises(ValueError):
        W.read_record(records[0].replace(b"hello", b"jello"))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-empty")
    assert W.write_archive(empty, folder).collect() == []
    back = W.read_archive(spark, folder, payload=True)
    assert back.collect() == [] and back.columns[0] == "page_id"
