"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Spark's own text writer stores the archives, so they land on any file system that Spark reaches: each row is
one frame, and the line separator is itself an empty skippable frame.  A task begins a new archive whenever one
has ARCHIVE_BYTES of records, so what a reader holds is bounded by that and its longest record.  The reader takes
archives as binary files, walks the frames by their block headers, and validates magic numbers, sizes, header
lines, Content-Length, record ends and payload digests.  A damaged record gives a row that says so, and the
records after it are read; where the frames themselves cannot be followed, one such row ends the archive.

Records with equal payloads of at least 100 bytes are kept once (``response``, smallest page_id); the others
are ``revisit`` records with the same HTTP headers and no body.

The reader also takes what others write by the standard: any record id, digests by SHA-1, SHA-256 or MD5 in hex or base32 (others
are handed on unchecked), none at all, block digests, all record types, headers with any blanks behind the colon and folded
lines, blocks that are no HTTP message, frames without a size, and files of any name.

Results for odd input: a null payload is empty; a null URL leaves the target header out; control characters in
URLs are percent-encoded; a null page_id is written as ``null`` and never refers or is referred to; repeated
rows of a response are responses too; records of other writers have a null page_id and refers_to, and their ids in record_id and
refers_to_id; their payload_digest is taken from the payload, and for revisits from the header if it is SHA-256, else null; empty tables make no archive and no rows; a folder that is not there is an
error; other columns of the pages are left out.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, scratch_dir, table

DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, 0x184D2A50
#: An empty skippable frame; ends every row that the text writer stores.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
LEAST_REVISIT = 100
#: Records of an archive that its dictionary is trained on, bytes of each, and the dictionary's size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 16_384
#: Bytes of records of an archive, before they are compressed, and of records that are handed on at once.
ARCHIVE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, "
    "record_id string, record_date string, refers_to_id string, content_type string, error string"
)
DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?")
PAGE = re.compile(r"<urn:page:(-?\d+)>")


class Damaged(ValueError):
    """An archive or record that breaks the format."""


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        body += payload
    else:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def header_fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank goes on with the one before it."""
    pairs: list[list[str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1][1] += " " + line.strip(" \t")
        elif colon and re.fullmatch(r"[!#-'*+.^-z|~0-9A-Z-]+", name):
            pairs.append([name.lower(), value.strip(" \t")])
        else:
            raise Damaged(f"bad header line {line!r}")
    fields = dict(pairs)
    many = [name for name, _ in pairs if name != "warc-concurrent-to"]
    if len(set(many)) < len(many):
        raise Damaged("a header comes twice")
    return fields


def digest_of(value: str) -> tuple[str, bytes | None]:
    """Algorithm and bytes of a digest header; no bytes for an algorithm that isn't known here."""
    name, colon, text = value.partition(":")
    name = name.lower().replace("-", "")
    if not colon:
        raise Damaged("bad digest")
    if name not in ("sha1", "sha256", "md5"):
        return name, None
    size = hashlib.new(name).digest_size
    try:
        if len(text) == 2 * size:
            return name, bytes.fromhex(text)
        text = text.rstrip("=").upper()
        raw = base64.b32decode(text + "=" * (-len(text) % 8))
    except (ValueError, binascii.Error):
        raise Damaged("bad digest") from None
    if len(raw) != size:
        raise Damaged("bad digest")
    return name, raw


def check_digest(fields: dict[str, str], header: str, data: bytes) -> None:
    if header in fields:
        name, raw = digest_of(fields[header])
        if raw is not None and hashlib.new(name, data).digest() != raw:
            raise Damaged(f"{header} doesn't fit")


def parse_record(data: bytes) -> tuple:
    """A row of RECORD_SCHEMA but for its error; raises Damaged where a header, length or digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged("no WARC version line")
    fields = header_fields(lines[1:])
    try:
        length, kind = fields["content-length"], fields["warc-type"].lower()
        ident, date = fields["warc-record-id"], fields["warc-date"]
    except KeyError as e:
        raise Damaged(f"missing header: {e}") from None
    if not re.fullmatch(r"<[^<>\s]+>", ident) or not DATE.fullmatch(date) or not re.fullmatch(r"[0-9]+", length):
        raise Damaged("bad record id, date or length")
    block = rest[: int(length)]
    if len(rest) != int(length) + 4 or rest[int(length) :] != b"\r\n\r\n":
        raise Damaged("Content-Length doesn't fit the record")
    check_digest(fields, "warc-block-digest", block)
    payload, size, media = block, None, fields.get("content-type")
    if (media or "").lower().startswith("application/http") and (block or kind != "revisit"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found or not (http.startswith(b"HTTP/") or kind == "request"):
            raise Damaged("bad HTTP headers")
        sizes = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$", http)
        coded = re.search(rb"(?im)^(?:Transfer|Content)-Encoding:", http)
        size = int(sizes[1]) if sizes else None
        if kind == "response" and size not in (None, len(payload)) and not coded and "warc-truncated" not in fields:
            raise Damaged("payload doesn't fit its length")
    to = fields.get("warc-refers-to")
    if kind == "revisit":
        if "warc-profile" not in fields or payload and "identical-payload" in fields["warc-profile"]:
            raise Damaged("bad revisit record")
        name, raw = digest_of(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else ("", None)
        digest, payload = raw.hex() if raw is not None and name == "sha256" else None, b""
    else:
        if "warc-truncated" not in fields:
            check_digest(fields, "warc-payload-digest", payload)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    page, refers = PAGE.fullmatch(ident), PAGE.fullmatch(to or "")
    return (
        int(page[1]) if page else None, fields.get("warc-target-uri"), size, digest, kind, int(refers[1]) if refers and kind == "revisit" else None, payload,
        ident[1:-1], date, to and to.strip("<>"), media,
    )


def frame_size(data: memoryview, at: int) -> int:
    """Length of the compressed frame that starts here, by its header and block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    end = at + zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        if end + 3 > len(data):
            raise Damaged("frame is cut off")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    return end + 4 * zstandard.get_frame_parameters(head).has_checksum - at


def read_archive(content: bytes) -> Iterator[bytes | Damaged]:
    """The records of one archive, decompressed; in place of a damaged one what is wrong with it."""
    import zstandard

    data, at, inflate, first = memoryview(content), 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if at + 8 > len(data):
            yield Damaged("archive is cut off")
            return
        magic, length = struct.unpack_from("<II", data, at)
        if magic == FRAME_MAGIC:
            try:
                length = frame_size(data, at)
            except (Damaged, zstandard.ZstdError) as e:
                yield Damaged(f"the frames end here: {e}")
                return
            frame = data[at : at + length]
            try:
                known = zstandard.frame_content_size(frame)
                if at + length > len(data):
                    raise Damaged("frame is cut off")
                out = inflate.decompress(frame) if known >= 0 else inflate.decompressobj().decompress(frame)
                yield out if known < 0 or len(out) == known else Damaged("frame has another size than it says")
            except (Damaged, zstandard.ZstdError) as e:
                yield Damaged(str(e))
            at += length
        elif magic & 0xFFFFFFF0 == SKIPPABLE:
            body = bytes(data[at + 8 : at + 8 + length])
            at += 8 + length
            if at > len(data):
                yield Damaged("archive is cut off")
                return
            if magic == DICTIONARY_MAGIC and not first:
                yield Damaged("the dictionary isn't the first frame")
            elif magic == DICTIONARY_MAGIC:
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompress(body)
                inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        else:
            yield Damaged(f"the frames end here: unknown frame {magic:#x}")
            return
        first = False


def make_dictionary(samples: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x[:SAMPLE_BYTES] for x in samples])
    except zstandard.ZstdError:  # too few or too uniform: the records themselves serve
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(batches: Iterator[pa.RecordBatch], archive_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    """Rows of one task into the frames of its archives, in each the dictionary first: archive, n (place in it) and frame."""
    import zstandard

    part, number, size, deflate = TaskContext.get().partitionId(), -1, 0, None
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["archive", "n", "frame"])

    def add(frame: bytes) -> None:
        rows.append((f"{part:06d}-{number:06d}", at + len(rows), frame))

    at = 0
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        records = (
            record(page_id, url, (html or "").encode(), digest, refers, date)
            for page_id, url, html, digest, refers in (tuple(c[i].as_py() for c in columns) for i in range(len(batch)))
        )
        for one in records:
            if deflate is None or size >= archive_bytes:
                head, total = [one], len(one)
                while len(head) < SAMPLES and total < archive_bytes and (more := next(records, None)):
                    head.append(more)
                    total += len(more)
                words = make_dictionary(head)
                number, size = number + 1, 0
                packed = zstandard.ZstdCompressor(level=9).compress(words.as_bytes())
                add(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
                deflate = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
            else:
                head = [one]
            for r in head:
                add(deflate.compress(r))
                size += len(r)
                held += len(r)
            if held >= BATCH_BYTES:
                yield flush()
                at += len(rows)
                rows.clear()
                held = 0
    if rows:
        yield flush()


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the records that repeat an earlier payload; copies are combined per task first."""
    sized = pages.select("page_id", "digest", F.octet_length("html").alias("n")).where(f"n >= {LEAST_REVISIT}")
    sized = materialise(sized.select("page_id", "digest"), "payloads")
    first = sized.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # written first, so that both sides of the join are exchanges and AQE can split a hot digest
    later = sized.join(materialise(first.drop("n"), "payload-heads"), "digest").where("page_id > refers_to")
    return later.dropDuplicates(["page_id", "digest"])


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of the rows (page_id, url, html) into folders below ``path``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "digest", F.sha2(F.coalesce("html", F.lit("")), 256)
    )
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())  # one for all, so that a repeated task writes the same
    rows = pages.join(revisits(pages), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    frames = rows.mapInArrow(lambda batches: _frames(batches, archive_bytes, date), "archive string, n long, frame binary").sortWithinPartitions("archive", "n")
    frames = frames.select("archive", F.col("frame").cast("string").alias("value"))
    frames.write.partitionBy("archive").option("lineSep", SEPARATOR.decode("ascii")).text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path`` (RECORD_SCHEMA); damaged ones have an error and nothing else."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]
    body = names.index("payload")

    def row_of(data: bytes | Damaged) -> tuple:
        try:
            if isinstance(data, Damaged):
                raise data
            row = parse_record(data)
            return (*(row if payloads else (*row[:body], None, *row[body + 1 :])), None)
        except (Damaged, UnicodeDecodeError) as e:
            return (*[None] * (len(names) - 1), str(e))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
        )
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in read_archive(content.as_py()):
                    rows.append(row_of(data))
                    held += len(data) if payloads and isinstance(data, bytes) else 0
                    if len(rows) >= 5000 or held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return archives.select("content").mapInArrow(records, RECORD_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": f"""
WITH a AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM a)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id > head THEN head END AS refers_to FROM b"""
}
