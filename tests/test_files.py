"""Files read in splits and archive members against plain readers."""

import io
import random
import re
import tarfile

import pytest

from lexiloom.sources import archives, parsers, split_files


def plain_lines(text: str) -> list[str]:
    lines = re.split("\r\n|\n|\r", text)
    return lines if lines[-1] else lines[:-1]


def plain_blocks(text: str) -> list[str]:
    out, held = [], []
    for line in plain_lines(text):
        if line.rstrip():
            held.append(line.rstrip())
        elif held:
            out.append("\n".join(held))
            held = []
    return out


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_blocks_and_lines_of_split_files(spark, tmp_path, small_splits):
    """Blocks longer than splits, runs of blank lines, blanks at line ends, files that end in all ways."""
    rng, texts = random.Random(8), []
    for i in range(12):
        lines = [rng.choice(["", "", " \t", "x", "é" * 30, "a b  ", "w" * 150]) for _ in range(rng.randrange(0, 60))]
        texts.append(rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n", "\n\n", "\nlast", "\n \n"]))
        (tmp_path / f"{i:02}.txt").write_bytes(texts[-1].encode())
    found = split_files.file_blocks(spark, f"file://{tmp_path}").collect()
    of = lambda rows, i: [r for r in rows if r.file.endswith(f"/{i:02}.txt")]
    for i, text in enumerate(texts):
        assert [r.value for r in sorted(of(found, i), key=lambda r: (r.split, r.nth))] == plain_blocks(text), text
    lines = split_files.file_lines(spark, f"file://{tmp_path}")
    assert split_files.split_lines(spark, f"file://{tmp_path}").rdd.getNumPartitions() > 24
    rows = lines.collect()
    for i, text in enumerate(texts):
        expected = [(n, x) for n, x in enumerate(plain_lines(text)) if x]
        assert sorted((r.line_no, r.value) for r in of(rows, i)) == expected
    assert len({(r.file, r.split) for r in found}) > 12


def test_dictionary_lines_keep_their_order(spark, tmp_path, small_splits):
    (tmp_path / "vocabulary.txt").write_text("".join(f"token{i % 40}\n" for i in range(100)))
    found = {r.token: r.id for r in parsers.vocabulary(parsers.text_lines(spark, f"file://{tmp_path}/vocabulary.txt")).collect()}
    assert found == {f"token{i % 40}": i for i in range(100)}


def packed(members: list[tuple[str, bytes]], mode: str = "w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        tar.addfile(tarfile.TarInfo("folder.nxml"))
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link.nxml")
        link.type, link.linkname = tarfile.SYMTYPE, "a.nxml"
        tar.addfile(link)
    return out.getvalue()


def test_archive_members(spark, tmp_path):
    """Only full texts come out; a broken archive gives what stands before the damage, and an error."""
    whole = packed([("a/1.nxml", b"<x/>" * 9_000), ("a/1.pdf", b"no"), ("a/2.nxml", "é".encode())])
    noise = random.Random(1).randbytes(60_000)
    files = {"one.tar.gz": whole, "two.tar.gz": packed([("3.nxml", b"3"), ("4.nxml", noise)])[:-20_000], "none.tar.gz": b"\x1f\x8bjunk", "other.zip": whole}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = archives.members(archives.archives(spark, f"file://{tmp_path}")).collect()
    got = {(r.archive.rsplit("/", 1)[1], r.member): bytes(r.data) for r in rows if r.error is None}
    assert got == {("one.tar.gz", "folder.nxml"): b"", ("one.tar.gz", "a/1.nxml"): b"<x/>" * 9_000, ("one.tar.gz", "a/2.nxml"): "é".encode(), ("two.tar.gz", "folder.nxml"): b"", ("two.tar.gz", "3.nxml"): b"3"}
    assert {r.archive.rsplit("/", 1)[1] for r in rows if r.error} == {"two.tar.gz", "none.tar.gz"}
    assert archives.members(spark.createDataFrame([("a", None)], "archive string, content binary")).first().error == "no archive"


def test_articles_equal_paths(spark):
    """The pull parser gives what path expressions give, on random nestings."""
    rng, rows = random.Random(3), []
    names = ["p", "sec", "abstract", "body", "article-title", "italic", "article-id pub-id-type='pmc'", "article-id pub-id-type='doi'"]

    def element(depth: int) -> str:
        name = rng.choice(names)
        inner = "".join(element(depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice(["t", " a &amp; b ", "é&#8364;", "\n"]) for _ in range(rng.randrange(0, 4)))
        return f"<{name}>{inner}</{name.split()[0]}>"

    for _ in range(150):
        rows.append((f"<article>{''.join(element(0) for _ in range(4))}</article>",))
    df = spark.createDataFrame(rows, "xml string")
    expected = sorted(map(tuple, parsers.pmc(df).collect()))
    assert sorted(tuple(r)[:4] for r in archives.articles(df, "xml").collect()) == expected
    odd = spark.createDataFrame([(b"<a><b></a>",), (None,), ("<?xml version='1.0' encoding='latin-1'?><article-id pub-id-type='pmc'>\xe9</article-id>".encode("latin-1"),)], "data binary")
    found = archives.articles(odd).collect()
    assert [(r.doc_id, r.error is None) for r in found] == [(None, False), (None, False), ("é", True)] and "no XML" in found[0].error
