import gzip
import hashlib
import io
import json
from collections import Counter

import pytest

from murmur.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


ROWS = [
    (3, "http://a/ b\r\nX: y", "x" * 200, "clash"), (1, "http://b", "x" * 200, ""), (7, None, "x" * 200, ""), (2, "http://c", None, ""), (4, "http://d", "", ""),
    (5, "http://e", "short", ""), (6, "http://f", "short", ""), (8, "http://g", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9, ""), (9, "é", "é\n中文" * 50_000, ""),
    (1, "http://b", "x" * 200, ""), (10, "", "y" * 99, ""), (11, "", "y" * 99, ""), (12, "", "z" * 100, ""), (13, "", "z" * 100, ""), (None, "n", "q" * 150, ""),
]


def test_round_trip(spark):
    got = warc.round_trip(spark, pages(spark, ROWS)).collect()
    first = {}
    for i, _, html, _ in ROWS:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html, _ in ROWS:
        raw = (html or "").encode()
        revisit = len(raw) >= 100 and i is not None and first[html] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None, None if revisit else raw))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == Counter(want)
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


def test_normalised_archive(spark, tmp_path):
    rows = warc.with_revisits(pages(spark, ROWS))
    whole = warc.write_archives(rows.coalesce(1), f"file://{tmp_path}/whole", archive_bytes=400)
    made = warc.normalise(whole, f"file://{tmp_path}/own").collect()
    assert sum(m.n for m in made) == len(ROWS) and len(made) > 3
    for m in made:
        data = open(m.archive.removeprefix("file://"), "rb").read()
        index = [json.loads(x) for x in open(m.sidecar.removeprefix("file://"), "rb").read().splitlines()]
        assert len(index) == m.n and index[0]["offset"] == 0
        assert [x["offset"] + x["length"] for x in index] == [*(x["offset"] for x in index[1:]), len(data)]
        parts = [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index]
        assert b"".join(parts) == gzip.decompress(data)
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_records_cut_anywhere(size):
    raw = [warc.record(i, f"http://{i}", b"p" * (i * 37), "d", None if i % 2 else 4) for i in range(20)]
    stream = gzip.compress(b"".join(raw[:9])) + gzip.compress(b"".join(raw[9:]))
    file = io.BytesIO(stream)
    chunks = (c[i : i + size] for c in warc.inflated(file) for i in range(0, len(c), size))
    assert list(warc.records(chunks)) == raw


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    bad = spark.createDataFrame([(1, "u", b"payload", "0" * 64, None)], "page_id long, url string, payload binary, digest string, refers_to long")
    made = warc.normalise(warc.write_archives(bad, f"file://{tmp_path}/w"), f"file://{tmp_path}/o")
    with pytest.raises(Exception, match="not what was written"):
        warc.read_archives(made).collect()
