"""WARC writing and reading: round trips, revisits, framing errors."""

import gzip
import hashlib
import io
import re
import zlib

import pytest

from plumbline.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    out, groups = {}, {}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        groups.setdefault(body, []).append(page)
        out[page] = (len(body), hashlib.sha1(body).hexdigest())
    for body, ids in groups.items():
        best = max(ids)
        for i in ids:
            revisit = len(body) >= 1000 and i != best
            out[i] += ("revisit" if revisit else "response", best if revisit else None)
    return out


def test_round_trip(spark):
    long, same = "é<p>" * 400_000, "x" * 1000
    rows = [(1, "http://a/ b%20\n", same, "clash"), (2, None, same, ""), (9, "u", same, None), (3, "u", "x" * 999, ""), (4, "u", "x" * 999, ""),
            (5, "u", None, ""), (6, "u", "", ""), (7, "u", long, ""), (8, "u", long, "")]
    manifest = warc.write_archives(warc.choose_responses(pages(spark, rows)), roll_bytes=2000)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(manifest, keep_payload=True).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows)
    assert all(r.digest_ok for r in got)
    assert {r.page_id: r.url for r in got} == {r[0]: r[1] for r in rows}
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {
        i: next(r[2] or "" for r in rows if r[0] == i) for i, e in expected(rows).items() if e[2] == "response"}


def test_files_are_one_member_per_record(spark):
    rows = [(i, "u", "".join(f"<p>{i * k}</p>" for k in range(300)), "") for i in range(40)]
    for r in warc.write_archives(warc.choose_responses(pages(spark, rows)), roll_bytes=20_000).collect():
        raw = open(re.sub("^file:/+", "/", r.path), "rb").read()
        assert len(raw) == r.bytes
        members = 0
        while raw:
            inflate = zlib.decompressobj(wbits=31)
            block = inflate.decompress(raw)
            assert inflate.eof and block.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
            raw, members = inflate.unused_data, members + 1
        assert members == r.records


def test_repeated_rows_and_null_ids(spark):
    html = "y" * 2000
    rows = [(5, "b", html, ""), (5, "b", html, ""), (5, "a", html, ""), (None, "c", html, ""), (2, "d", html, "")]
    got = warc.read_archives(warc.write_archives(warc.choose_responses(pages(spark, rows)))).collect()
    assert sorted((r.record_type, r.refers_to or -1, r.url) for r in got if r.record_type == "response") == [("response", -1, "a")]
    assert all(r.refers_to == 5 for r in got if r.record_type == "revisit") and len(got) == 5
    alone = warc.read_archives(warc.write_archives(warc.choose_responses(pages(spark, [(None, "c", html, "")] * 2)))).collect()
    assert sorted(r.record_type for r in alone) == ["response", "revisit"]


def test_empty_table(spark):
    manifest = warc.write_archives(warc.choose_responses(pages(spark, [])))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def archive(*records):
    return b"".join(gzip.compress(r) for r in records)


def record(html="hello", digest=None):
    return warc.record_bytes(1, "u", html, digest or hashlib.sha1(html.encode()).hexdigest(), 1, "response", None)


def test_reader_in_small_pieces():
    data = archive(*[record("z" * n) for n in (0, 1, 70_000, 5)])
    for piece in (1, 7, 4096):
        class Slow(io.BytesIO):
            def read(self, n=-1, piece=piece):
                return super().read(min(n, piece))

        assert [r["payload_bytes"] for r in warc.read_records(Slow(data))] == [0, 1, 70_000, 5]


def test_wrong_digest_is_told():
    (got,) = warc.read_records(io.BytesIO(archive(record(digest="0" * 40))))
    assert not got["digest_ok"] and got["payload_digest"] == hashlib.sha1(b"hello").hexdigest()


@pytest.mark.parametrize("data", [
    archive(record())[:-12],
    gzip.compress(record() + record()),
    gzip.compress(record()[:-6]),
    gzip.compress(record().replace(b"Content-Length: 7", b"Content-Length: 9")[:40]),
])
def test_framing_errors(data):
    with pytest.raises((ValueError, KeyError)):
        list(warc.read_records(io.BytesIO(data)))
