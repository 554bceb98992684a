import base64
import gzip
import hashlib

import pytest

from larder.llm.archives import ARC_FIELDS, arc_head, arc_records, arc_to_warc, page_archive, read_arc, read_warc, warc_records, write_archive
from pyspark.sql import functions as F


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(version, url, block):
    middle = b"" if version == 1 else b"200 - - 0 - "
    return b"%s 1.2.3.4 20010203040506 text/html %s%d\n%s\n" % (url, middle, len(block), block)


def test_both_versions_are_cut_by_length_alone():
    tricky = b"HTTP/1.0 200 OK\r\n\r\nhttp://x 1.2.3.4 20010101000000 text/html 5\nWARC/1.0\r\n\n\n"
    for version in (1, 2):
        data = arc_head(version, "20010101000000").encode() + b"\n" + record(version, b"http://a b/", tricky) + record(version, b"http://c/", b"")
        got = list(arc_records(data))
        assert [b for _, b in got] == [tricky, b""]
        assert got[0][0]["URL"] == b"http://a b/" and got[0][0]["Archive-date"] == b"20010203040506"
        assert set(got[0][0]) == {*ARC_FIELDS[version].split(" "), "version"}


@pytest.mark.parametrize(
    "data",
    [
        b"http://a/ 1.2.3.4 20010101000000 text/html 3\nabc\n",
        arc_head(1, "20010101000000").encode() + b"\n" + b"http://a/ 1.2.3.4 20010101000000 text/html 30\nabc\n",
        b"filedesc://x 0.0.0.0 20010101000000 text/plain 12\n7 0 nobody\nURL",
    ],
)
def test_broken_files_are_errors(data):
    with pytest.raises(ValueError):
        list(arc_records(data))


PAGES = [
    (1, "http://a/", "<p>same</p>", "clash"),
    (2, "http://b/", "<p>same</p>", "clash"),
    (3, None, None, "clash"),
    (4, "http://d/ x\ty\nz", "", "clash"),
    (5, "", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", None),
    (6, "http://é/", "été 漢字 \U0001f600 \u0000", "clash"),
    (7, "http://long/", "x" * 3_000_000, "clash"),
    (2, "http://b/", "<p>same</p>", "clash"),
    (None, "http://n/", "<p>same</p>", "clash"),
    (-9, "http://m/", "<p>other</p>", "clash"),
    (8, "http://o/", "<p>other</p>", "clash"),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_pages_there_and_back(spark, tmp_path, parts):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, head string").repartition(parts)
    out = page_archive(pages, str(tmp_path)).collect()
    assert len(out) == len(PAGES)
    first = {}
    for i, _, html, _ in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", i)
    want = []
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        again = i is None or first[html or ""] != i
        want.append((i, len(data), digest(data), "revisit" if again else "response", first[html or ""] if again else None))
    key = lambda t: tuple(str(x) for x in t)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)
    # What was written are archives that another reader could open.
    total = 0
    for path in (tmp_path / "warc").glob("part-*"):
        fields = [f for f, _ in warc_records(gzip.decompress(path.read_bytes()))]
        assert fields[0]["warc-type"] == "warcinfo"
        assert all(f["warc-date"] == "2024-01-01T00:00:00Z" for f in fields)
        total += len(fields) - 1
    assert total == len(PAGES)


def test_empty_table(spark, tmp_path):
    assert page_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)).collect() == []


def test_files_hold_a_bounded_number_of_records(spark, tmp_path):
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nX-Page-Id: "), F.col("id").cast("string"), F.lit("\r\n\r\nbody"), (F.col("id") % 40).cast("string"))
    line = F.concat(F.lit("http://h/ 1.1.1.1 20240506070809 text/html "), F.octet_length(block).cast("string"), F.lit("\n"), block)
    rows = spark.range(0, 95, 1, 1).select(line.alias("value"))
    write_archive(rows, f"{tmp_path}/arc", [arc_head(1, "20240101000000")], "\n", compress=True, per_file=20)
    assert len(list((tmp_path / "arc").glob("part-*"))) == 5
    assert read_arc(spark, f"{tmp_path}/arc", bodies=False).count() == 95
    order = F.regexp_extract("head", r"X-Page-Id: (\d+)", 1).cast("long")
    warc = arc_to_warc(spark, f"{tmp_path}/arc", order, least_bytes=6)
    write_archive(warc, f"{tmp_path}/warc", ["WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n"], "\r\n\r\n", compress=False)
    back = read_warc(spark, f"{tmp_path}/warc").collect()
    # Bodies of five bytes are too short to be revisits.
    assert sum(r.record_type == "revisit" for r in back) == 95 - 40 - sum(i >= 40 and i % 40 < 10 for i in range(95))
    assert {r.date for r in back} == {"2024-05-06T07:08:09Z"}


def test_files_are_closed_by_bytes_too(spark, tmp_path):
    blocks = [f"{i} " + "x" * (30_000 if i % 7 == 0 else 10) for i in range(60)]
    lines = spark.createDataFrame([(f"http://a/ 0.0.0.0 20240101000000 text/html {len(b)}\n{b}",) for b in blocks], "value string").coalesce(1)
    write_archive(lines, str(tmp_path / "arc"), [arc_head(1, "20240101000000")], "\n", compress=False, per_file=20, file_bytes=40_000)
    files = sorted((tmp_path / "arc").glob("part-*"))
    assert len(files) > 3 and all(f.stat().st_size < 75_000 for f in files)
    got = [block.decode() for f in files for _, block in arc_records(f.read_bytes())]
    assert sorted(got) == sorted(blocks)
