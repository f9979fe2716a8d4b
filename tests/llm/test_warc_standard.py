"""Archives that other writers make."""

import base64
import hashlib

import pytest
import zstandard

from lexiloom.llm import warc

HTML = b"<p>\xc3\xa9</p>"
B32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"


def made(kind: str, block: bytes, *lines: str, version: str = "WARC/1.0") -> bytes:
    head = [version, f"WARC-Type: {kind}", "WARC-Date: 2024-05-06T07:08:09Z", f"WARC-Record-ID: <urn:uuid:{kind}>", *lines, f"Content-Length:  {len(block)} "]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORDS = {
    "warcinfo": made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Filename: a.warc.zst"),
    "request": made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type:application/http;msgtype=request", "WARC-Target-URI: http://a/", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"),
    "response": made("response", HTTP + HTML, "content-type:\tapplication/http; msgtype=response", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{B32(HTML)}", f"WARC-Block-Digest: sha1:{B32(HTTP + HTML)}"),
    "revisit": made("revisit", b"", "Content-Type: application/http", "WARC-Refers-To: <urn:uuid:response>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/", "  identical-payload-digest", f"WARC-Payload-Digest: SHA-256:{hashlib.sha256(HTML).hexdigest().upper()}"),
    "metadata": made("metadata", b"fetchTimeMs: 5\r\n", "Content-Type: application/warc-fields", version="WARC/1.1"),
    "resource": made("resource", b"", "Content-Type: text/plain", "WARC-Payload-Digest: blake3:abc"),
    "x-new": made("x-new", b"any\r\n\r\nthing"),
}


def test_records_of_all_types(spark, tmp_path):
    plain, sizeless = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(write_content_size=False)
    frames = [(sizeless if i % 2 else plain).compress(x) for i, x in enumerate(RECORDS.values())]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "CC-MAIN.warc.zst").write_bytes(b"".join(frames))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = {r["record_type"]: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert rows.keys() == RECORDS.keys() and all(r["error"] is None and r["page_id"] is None and r["record_id"] == f"urn:uuid:{k}" for k, r in rows.items())
    one, again = rows["response"], rows["revisit"]
    assert bytes(one["payload"]) == HTML and one["payload_bytes"] == len(HTML) and one["payload_digest"] == hashlib.sha256(HTML).hexdigest() == again["payload_digest"]
    assert one["url"] == "http://a/" and one["record_date"] == "2024-05-06T07:08:09Z" and again["refers_to_id"] == "urn:uuid:response" and again["refers_to"] is None
    assert bytes(rows["warcinfo"]["payload"]) == b"software: x\r\n" and bytes(rows["request"]["payload"]) == b"" and bytes(rows["x-new"]["payload"]) == b"any\r\n\r\nthing"
    assert again["payload_bytes"] is None and rows["resource"]["payload_bytes"] == 0


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"2024-05-06T07:08:09Z", b"yesterday"), (b"WARC-Date: 2024-05-06T07:08:09Z\r\n", b""), (b"<urn:uuid:response>", b"urn:uuid:response"), (b"<p>", b"<q>"),
        (B32(HTML).encode(), b"AAAA"), (b"Server: x", b"Server: y"), (b"HTTP/1.1 200 OK", b"HTTQ"), (b"WARC-Target-URI:", b"WARC Target:"),
        (b"Server: x", b"Content-Length: 3"), (b"Content-Length:  ", b"Content-Length: -"),
    ],
)
def test_damage_is_told(old, new):
    assert old in RECORDS["response"]
    with pytest.raises(warc.Damaged):
        warc.parse_record(RECORDS["response"].replace(old, new))


def test_lengths_of_coded_and_cut_bodies_are_not_held_against_them():
    for line in (b"Content-Length: 99\r\nContent-Encoding: gzip", b"Content-Length: 99\r\nTransfer-Encoding: chunked"):
        assert warc.parse_record(made("response", HTTP.replace(b"Server: x", line) + HTML, "Content-Type: application/http"))[2] == len(HTML)
    cut = made("response", HTTP.replace(b"Server: x", b"Content-Length: 99") + HTML, "Content-Type: application/http", "WARC-Truncated: length", f"WARC-Payload-Digest: sha1:{B32(b'all')}")
    assert warc.parse_record(cut)[2] == len(HTML)


def test_own_records_have_a_date():
    row = warc.parse_record(warc.record(7, "http://a/", HTML, hashlib.sha256(HTML).hexdigest(), None, "2025-01-02T03:04:05Z"))
    assert row[0] == 7 and row[8] == "2025-01-02T03:04:05Z" and row[4] == "response"
