"""WARC archives: round trips, revisits, one member per record, damaged and foreign archives."""

import base64
import glob
import gzip
import hashlib
import zlib

import pytest

from visitlens.llm import warc

PAGE = "page_id long, url string, html string, record string, digest string, first long"


def pages_of(spark, rows):
    """Pages with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], PAGE).repartition(3)


def archive_files(folder):
    return sorted(glob.glob(f"{folder}/part-*"))


def members_of(data):
    found = []
    while data:
        inflate = zlib.decompressobj(31)
        found.append(inflate.decompress(data))
        assert inflate.eof
        data = inflate.unused_data
    return found


def brute(rows):
    """(id, payload, record_type, refers_to) per row."""
    ids = {}
    for row, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and row is not None:
            ids[payload] = min(row, ids.get(payload, row))
    out = []
    for row, _, html in rows:
        payload = (html or "").encode()
        first = ids.get(payload)
        again = first is not None and row != first
        out.append((row, payload, "revisit" if again else "response", first if again else None))
    return out


def test_round_trip_of_awkward_pages(spark, tmp_path):
    long, shared = "<p>" + "ä€𝄞 text " * 300_000, "<html>" + "same " * 40 + "</html>"
    rows = [
        (1, "http://a.org/", "<p>one</p>"), (2, None, None), (3, "http://a.org/x y\r\nWARC-Type: warcinfo", ""), (9, "http://b.org/", shared),
        (4, "http://c.org/", shared), (7, "http://d.org/é\x00", shared), (None, "http://e.org/", shared), (4, "http://c.org/", shared),
        (None, None, None), (12, "u", long), (11, "u", long), (None, "n", "z" * 200), (None, "n", "z" * 200), (5, "v", "short"), (6, "v", "short"),
        (13, "w", "WARC/1.1\r\n\r\nfake\r\n\r\n\x1f\x8b\x08" + "q" * 99)]
    folder = warc.write_archives(pages_of(spark, rows), str(tmp_path / "a"), date="2024-05-06T07:08:09Z")
    got = warc.read_archives(spark, folder).collect()
    assert all(r["problem"] is None for r in got)
    records = [r for r in got if r["record_type"] != "warcinfo"]
    ids = [int(r["row_id"]) if r["row_id"] else None for r in records]
    full = {digest: p for p in (x[1] for x in brute(rows)) for digest in [hashlib.sha256(p).hexdigest()]}
    have = sorted(((i, full[r["payload_digest"]], r["record_type"], int(r["refers_to_row_id"]) if r["refers_to_row_id"] else None)
                   for i, r in zip(ids, records)), key=repr)
    assert have == sorted(brute(rows), key=repr)
    for r in records:
        assert r["payload_bytes"] == len(full[r["payload_digest"]]) and r["date"] == "2024-05-06T07:08:09Z"
        assert r["payload"] == (None if r["record_type"] == "revisit" else full[r["payload_digest"]])
    responses = {r["record_id"] for r in records if r["record_type"] == "response"}
    assert all(r["refers_to"] in responses for r in records if r["record_type"] == "revisit")
    assert {r["target_uri"] for r in records if r["row_id"] == "3"} == {"http://a.org/x%20y%0D%0AWARC-Type:%20warcinfo"}
    light = warc.read_archives(spark, folder, payloads=False)
    assert sorted(r["payload_digest"] for r in light.collect()) == sorted(r["payload_digest"] for r in got)
    assert light.filter("payload IS NOT NULL").count() == 0


def test_one_member_per_record_and_archives_of_bounded_size(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", f"page {i} " * 50) for i in range(300)]
    folder = warc.write_archives(pages_of(spark, rows), str(tmp_path / "a"), archive_bytes=4000)
    files, seen = archive_files(folder), 0
    assert len(files) >= 30
    for file in files:
        data = open(file, "rb").read()
        own = members_of(data)
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in own)
        if own:
            assert own[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and len(own) <= 14
        assert gzip.decompress(data) == b"".join(own)
        seen += sum(b"WARC-Type: response" in m for m in own)
    assert seen == 300


def test_members_whose_length_fills_the_last_byte():
    for size in (0, 10, (1 << 24) - 1, 1 << 24, (1 << 25) + 5):
        data = bytes(size)
        whole = warc._member([data]) + b"\0"
        assert b"".join(members_of(whole)) == data
    record = warc._page_record(1, "u", b"x" * (17 << 20), hashlib.sha256(b"x" * (17 << 20)).hexdigest(), False, None, "d") + b"\0"
    rows = list(warc.archive_records("a", record * 2))
    assert [r[-1] for r in rows] == [None, None] and rows[0][9] == 17 << 20


def test_heavy_payload_is_spread_and_keeps_its_first_page(spark, tmp_path):
    rows = [(i + 5, "u", "copy " * 30) for i in range(400)] + [(i + 1000, "u", f"other {i} " * 30) for i in range(300)]
    folder = warc.write_archives(pages_of(spark, rows), str(tmp_path / "a"))
    got = warc.read_archives(spark, folder, payloads=False).filter("record_type <> 'warcinfo'").collect()
    assert len(got) == 700
    assert sorted(int(r["row_id"]) for r in got if r["record_type"] == "response") == [5, *range(1000, 1300)]
    assert {r["refers_to_row_id"] for r in got if r["record_type"] == "revisit"} == {"5"}


def test_no_pages(spark, tmp_path):
    folder = warc.write_archives(pages_of(spark, []), str(tmp_path / "a"))
    assert warc.read_archives(spark, folder).count() == 0


def record_of(fields, block, tail=b"\r\n\r\n", length=None):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return gzip.compress(f"WARC/1.0\r\n{head}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + tail, mtime=0)


def test_foreign_records():
    block = b"plain resource"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    answer = b"HTTP/1.1 200 OK\r\n\r\n<p>"
    data = b"".join([
        record_of([("WARC-Type", "resource"), ("Content-Type", "text/plain"), ("WARC-Block-Digest", sha1)], block), gzip.compress(b""),
        record_of([("warc-type", "response"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha512:" + hashlib.sha512(b"<p>").hexdigest())], answer),
        record_of([("WARC-Type", "metadata"), ("WARC-Block-Digest", "whirlwind:abc")], b"")])
    rows = list(warc.archive_records("a", data))
    assert [(r[2], r[9], r[11], r[12]) for r in rows] == [
        ("resource", 14, block, None), ("response", 3, b"<p>", None), ("metadata", 0, b"", None)]


@pytest.mark.parametrize("bad, problem", [
    (record_of([("WARC-Type", "resource")], b"abc", length=9), "fewer bytes than its content length"),
    (record_of([("WARC-Type", "resource")], b"abcdefghij", length=3), "more bytes than its content length"),
    (record_of([("WARC-Type", "resource")], b"abc", tail=b"\r\n"), "fewer bytes than its content length"),
    (record_of([("WARC-Type", "resource"), ("WARC-Block-Digest", "sha1:" + "0" * 40)], b"abc"), "block digest differs"),
    (record_of([("WARC-Type", "resource"), ("WARC-Payload-Digest", "md5:" + "0" * 32)], b"abc"), "payload digest differs"),
    (record_of([("WARC-Type", "resource")], b"abc", length="many"), "no content length"),
    (gzip.compress(b"hello\r\n\r\n"), "no WARC record"),
    (gzip.compress(b"h" * (3 << 20)), "record head without end"),
    (b"garbage between the records", None),
    (record_of([("WARC-Type", "resource")], b"abc" * 999)[:-30], None),
])
def test_damage_is_reported_once_and_reading_goes_on(bad, problem):
    good = record_of([("WARC-Type", "resource"), ("WARC-Target-URI", "good")], b"fine")
    rows = list(warc.archive_records("a", good + bad + good))
    assert [r[5] for r in rows] == ["good", None, "good"]
    assert rows[1][-1] is not None and (problem is None or rows[1][-1] == problem)
    assert [r[5] for r in warc.archive_records("a", good + bad)] == ["good", None]


def test_flipped_bits_never_change_a_payload():
    """A bit may stand in the padding before the checksum; any other is noticed."""
    data = warc._page_record(1, "u", b"payload " * 40, hashlib.sha256(b"payload " * 40).hexdigest(), False, None, "d") + b"\0"
    for at in range(10, len(data)):
        broken = data[:at] + bytes([data[at] ^ 4]) + data[at + 1:]
        rows = list(warc.archive_records("a", broken))
        assert any(r[-1] for r in rows) or rows[0][11] == b"payload " * 40
