"""Archives: the plan against a row-by-row version, and whole payloads back from the files."""

import glob
import gzip
import hashlib
from collections import defaultdict

import pytest

from gradeloom.llm import repeats, warc

BODY = "<p>" + "é x " * 40 + "</p>"
ROWS = [
    (3, "http://a.b/c d\r\ne", BODY), (1, "http://a.b/", BODY), (1, "http://a.b/", BODY), (2, None, BODY), (None, "u", BODY), (4, "u", None), (5, "u", ""),
    (6, "u", "short"), (7, "u", "short"), (8, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 10), (9, "u", "z" * 3_000_000), (10, "u", "z" * 3_000_000), (None, None, "only " * 50), (None, None, "only " * 50),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, payload string, n int")


def expected(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        first = min(known) if known else None
        again = len(body) >= 100 and first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ROWS, [], [(i, f"u{i}", BODY * (1 + i % 2)) for i in range(100)]])
@pytest.mark.parametrize("chunk, file_bytes", [(1 << 20, 1 << 28), (1000, 2000)])
def test_round_trip(spark, tmp_path, monkeypatch, rows, chunk, file_bytes):
    monkeypatch.setattr(repeats, "FREQUENT_ROWS", 10)
    monkeypatch.setattr(warc, "CHUNK", chunk)  # of the reader
    files = warc.write_archives(warc.plan_records(pages(spark, rows)), str(tmp_path), chunk=chunk, file_bytes=file_bytes)
    chunks = warc.read_archives(files).persist()
    whole = warc.whole_records(chunks).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in whole), key=repr) == expected(rows)
    assert all(r.intact for r in whole if r.record_type == "response")
    parts = defaultdict(dict)
    for r in chunks.where("record_type = 'response'").collect():
        parts[r.file, r.record][r.chunk_no] = bytes(r.data)
        assert len(r.data) <= 2 * chunk
    bodies = sorted(b"".join(p[k] for k in range(len(p))) for p in parts.values())
    assert bodies == sorted((h or "").encode() for (_, _, h), e in zip(sorted(rows, key=repr), sorted(rows, key=repr)) if _kept(e, rows))
    assert sum(r.records for r in files.collect()) == len(rows)
    chunks.unpersist()


def _kept(row, rows):
    known = [i for i, _, h in rows if (h or "") == (row[2] or "") and i is not None]
    return len((row[2] or "").encode()) < 100 or not known or row[0] == min(known)


def test_query_form(spark):
    got = warc.archive_pages(pages(spark, ROWS)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(ROWS)


def test_members_are_records(spark, tmp_path):
    warc.write_archives(warc.plan_records(pages(spark, ROWS[:1])), str(tmp_path)).collect()
    (name,) = glob.glob(f"{tmp_path}/*.warc.gz")
    head, rest = gzip.open(name).read().split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and "WARC-Target-URI: http://a.b/c%20d%0D%0Ae" in lines and "WARC-Record-ID: <urn:page:3>" in lines
    assert int(next(v for v in lines if v.startswith("Content-Length")).split()[1]) == len(rest) - 4 and rest.endswith(b"</p>\r\n\r\n")


def test_other_archives(tmp_path):
    """Plain files, records of other kinds, folded headers, blocks without an HTTP head."""
    plain = tmp_path / "x.warc"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    own = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n  folded\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    plain.write_bytes(info + own + info)
    (row,) = warc.read_records(str(plain))
    assert (row["data"], row["url"], row["record"], row["intact"], row["page_id"]) == (b"abc", "http://a/ folded", 1, None, None)
    plain.write_bytes(b"")
    assert list(warc.read_records(str(plain))) == []
    for broken in (own[:-6], own[:40], b"no archive\r\n\r\n", own.replace(b"3", b"x"), own.replace(b"Length: 3", b"Length: 9")):
        plain.write_bytes(broken)
        with pytest.raises(ValueError, match="x.warc"):
            list(warc.read_records(str(plain)))
    zipped = tmp_path / "y.warc.gz"
    zipped.write_bytes((gzip.compress(own) + gzip.compress(own))[:-9])
    with pytest.raises(ValueError, match="y.warc"):
        list(warc.read_records(str(zipped)))


def test_lost_attempts_are_not_read(spark, tmp_path):
    records = warc.plan_records(pages(spark, ROWS))
    files = warc.write_archives(records, str(tmp_path))
    (tmp_path / "part-lost.warc.gz").write_bytes(b"half a file")
    assert warc.whole_records(warc.read_archives(files, with_data=False)).count() == len(ROWS)
