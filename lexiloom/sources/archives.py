"""Full texts in tar archives: members are streamed out of each archive, and each text is parsed once.

An archive is a tar file, packed by gzip or plain, and a row (``binaryFile`` reads one a file, of up to 2 GB); a task holds one archive, packed, and one member.

Results for odd input: Spark passes over empty files; an archive that breaks off gives the members before the damage and a row with an ``error``; null contents
give an error; members that are not files, or whose names end otherwise, are passed over; a text that is no XML, or a null one, has
null fields and an error.
"""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a text node that come as one piece at most; packed bytes that are unpacked at once.
BUFFER, PACKED = 1 << 24, 1 << 15
MEMBER = "archive string, member string, data binary, error string"
ARTICLE = "doc_id string, title string, abstract string, body string, error string"


def archives(spark: SparkSession, path: str, pattern: str = "*.tar.gz") -> DataFrame:
    """archive (its path) and content of the files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


class Unpacked:
    """Reads gzip data, of one or several parts, as far as it goes: where it breaks off, what was whole has been read before."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.part = memoryview(data), 0, b"", zlib.decompressobj(wbits=31)

    def read(self, size: int) -> bytes:
        out: list[bytes] = []
        while size and (self.held or self.at < len(self.data)):
            if not self.held:  # a little at a time, since what is not used yet is copied
                self.held = bytes(self.data[self.at : self.at + PACKED])
                self.at += len(self.held)
            out.append(self.part.decompress(self.held, size))
            size -= len(out[-1])
            self.held = self.part.unconsumed_tail
            if self.part.eof:
                self.held = self.part.unused_data.lstrip(b"\0")
                self.part = zlib.decompressobj(wbits=31)
        return b"".join(out)


def _members(content: bytes | None, suffix: str) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    if content is None:
        yield None, None, "no archive"
        return
    try:
        stream = Unpacked(content) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
        with tarfile.open(fileobj=stream, mode="r|", bufsize=tarfile.BLOCKSIZE) as tar:
            for member in tar:
                if member.isfile() and member.name.endswith(suffix):
                    file = tar.extractfile(member)
                    yield member.name, file.read() if file else b"", None
    except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
        yield None, None, f"broken archive: {type(e).__name__}"


def members(packed: DataFrame, suffix: str = ".nxml") -> DataFrame:
    """MEMBER rows of archives (archive, content): the members whose names end with ``suffix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for member, data, error in _members(content.as_py(), suffix):
                    columns = [pa.array([name.as_py()], pa.string()), pa.array([member], pa.string()), pa.array([data], pa.binary()), pa.array([error], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["archive", "member", "data", "error"])

    return packed.select("archive", "content").mapInArrow(run, MEMBER)


class Article:
    """What a pull parser leaves of an article: the text nodes of its title, of paragraphs of abstract and body, and its first PMC id."""

    def __init__(self) -> None:
        self.ids: list[str] = []
        self.parts: dict[str, list[str]] = {"title": [], "abstract": [], "body": []}
        self.open: list[tuple[list[str], set[str]]] = []
        self.depth = dict.fromkeys(("id", "title", "abstract", "body", "abstract p", "body p"), 0)

    def kinds(self, name: str, attributes: dict, titled: bool) -> list[str]:
        """The counters that an element raises while it is open."""
        own = [name] if name in ("abstract", "body") else []
        if name == "p":
            own += [f"{x} p" for x in ("abstract", "body") if self.depth[x]]
        if name == "article-title" and titled:
            own.append("title")
        if name == "article-id" and attributes.get("pub-id-type") == "pmc" and not self.ids:
            self.ids.append("")
            own.append("id")
        return own

    def start(self, name: str, attributes: dict) -> None:
        titled = not self.open or name not in self.open[-1][1]  # the first of its name among its siblings
        if self.open:
            self.open[-1][1].add(name)
        own = self.kinds(name, attributes, titled)
        for kind in own:
            self.depth[kind] += 1
        self.open.append((own, set()))

    def end(self, name: str) -> None:
        for kind in self.open.pop()[0]:
            self.depth[kind] -= 1

    def text(self, data: str) -> None:
        if self.depth["id"]:
            self.ids[0] += data
        for kind, part in (("title", "title"), ("abstract p", "abstract"), ("body p", "body")):
            if self.depth[kind]:
                self.parts[part].append(data)


def parse_article(data: bytes | str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """doc_id, title, abstract, body and error of one full text, in one pass."""
    if data is None:
        return None, None, None, None, "no text"
    article = Article()
    # a string is already decoded, whatever its first line says
    parser = expat.ParserCreate("UTF-8" if isinstance(data, str) else None)
    parser.buffer_text, parser.buffer_size = True, BUFFER
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = article.start, article.end, article.text
    try:
        parser.Parse(data.encode() if isinstance(data, str) else data, True)
    except expat.ExpatError as e:
        return None, None, None, None, f"no XML: {expat.errors.messages[e.code]}"
    title, abstract, body = (" ".join(article.parts[k]) for k in ("title", "abstract", "body"))
    return article.ids[0] if article.ids else "", title, abstract, body, None


def articles(texts: DataFrame, column: str = "data") -> DataFrame:
    """ARTICLE rows of full texts (``column``: binary or string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ARTICLE.split(", ")]
        for whole in batches:
            for i in range(0, len(whole), 256):
                rows = [parse_article(x.as_py()) for x in whole.slice(i, 256).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    return texts.select(column).mapInArrow(run, ARTICLE)
