import collections
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import bpe, chat_format, decontaminate, exact_dedup, golay, hilbert_shards, license_scan, simhash, toxicity, url_filter, warc
from lexiloom.llm.common import materialise
from lexiloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"
ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a b c"), (None, "x"), (None, None), (5, "w" * 50_000), (6, "\x00 \x1c é \U0001f600")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, 1.0, 2) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_url_split_and_rules():
    judge = lambda u: next(url_filter.UrlFilter().judge([u]))[:4]
    assert judge(None) == ("", "", None, "allow") and judge("x/y") == ("", "", None, "allow")
    assert judge("http://A.Example.com/en/7?q") == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert judge("http://b.com/en/1") == ("b.com", "/en/1", "com/en/", "block")
    assert judge("http://www.cheap-pills.org/")[3] == "block" and judge("http://pillsbury.org/")[3] == "allow"
    assert judge("http://free.org/")[3] == "allow" and judge("http://free.org/win")[3] == "block"


def test_url_weights_and_odd_tables(spark, nothing):
    """One strict term, or several soft ones whose weights reach the limit; columns with clashing names; nulls; no rows."""
    judge = lambda u: next(url_filter.UrlFilter().judge([u]))
    assert judge("http://library.org/adult-education")[3:] == ("allow", 0, 1, 1.0) and judge("http://a.org/adult/adult/ADULT")[3] == "allow"
    assert judge("http://a.org/casino-deal")[3:] == ("block", 0, 2, 1.6) and judge("http://a.org/deal-click")[3:] == ("allow", 0, 2, 0.8)
    assert judge("http://a.org/porn")[3:5] == ("block", 1) and judge("http://a.org/porn1")[3] == "allow" and judge("http://a.org/épornà")[3] == "block"
    rows = [(1, "http://a.com/en/", "h", "j", "r"), (2, None, None, None, None), (3, "", "", "", ""), (3, "", "", "", ""), (None, "x" * 100_000 + "://porn", "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, `my url` string, host string, judged string, judged_ string")
    got = url_filter.UrlFilter().apply(df, "my url")
    assert got.columns == ["page_id", "my url", "judged", "judged_", *[x.split()[0] for x in url_filter.SCHEMA.split(", ")]]
    found = sorted((r["page_id"] or 0, r["host"][:3], r["rule"], r["verdict"]) for r in got.collect())
    assert found == [(0, "por", None, "block"), (1, "a.c", "com/en/", "block"), (2, "", None, "allow"), (3, "", None, "allow"), (3, "", None, "allow")]
    assert url_filter.UrlFilter().apply(df.limit(0), "my url").count() == 0


def test_url_automaton_equals_plain_search():
    """Every term sought alone at every place, on random strings of terms and separators."""
    rng, own = random.Random(21), url_filter.UrlFilter()
    parts = [*url_filter.STRICT, *url_filter.SOFT, "-", "/", ".", "x", "9", "é", "A", "?"]
    for _ in range(400):
        u = "http://" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        low = "".join(c.lower() if c.isascii() else c for c in u)
        has = lambda t: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low) is not None
        soft = {t: w for t, w in url_filter.SOFT.items() if has(t)}
        row = next(own.judge([u]))
        assert row[4:] == (sum(map(has, url_filter.STRICT)), len(soft), round(sum(soft.values()), 6))


def test_bpe_equals_tokenizer():
    import public_tokenizers
    import tiktoken

    codec = bpe.codec(bpe.default_vocabulary())
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["aaaa", " ", "  ", "\n", "\t", "\x1c", "\x85", "'s", "'ll", "12", "<|endoftext|>", "é", "漢", "\U0001f600", "\U00018f5c"]
    for _ in range(500):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else chr(rng.randrange(32, 0xD000)) for _ in range(rng.randrange(40)))
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_columns(odd, nothing):
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows) and len(rows) == len(ODD)
    assert bpe.encode(nothing).count() == 0 and bpe.digests(odd).count() == len(ODD)


def test_hash_is_minimal_and_perfect():
    digests = np.random.default_rng(0).integers(0, 256, (3000, 32), np.uint8)
    sizes, bits, slot = exact_dedup.build_hash(digests)
    assert sorted(slot) == list(range(3000))
    assert (exact_dedup.find_slots(digests, sizes, bits) == slot).all()


def test_exact_dedup(odd, nothing):
    rows = exact_dedup.dedup(odd, exact_dedup.earlier_half()).collect()
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[hashlib.sha256((t or "").encode()).digest()].append(i)
    assert len(rows) == len(ODD)
    for r in rows:
        ids = groups[bytes(r["digest"])]
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None) and r["group_size"] == len(ids)
    assert sum(r["kept"] for r in rows) == len(groups) == exact_dedup.keep_one(odd).count()
    assert exact_dedup.keep_one(nothing).count() == 0


def test_exact_dedup_of_odd_ids_and_hot_rows(spark):
    """The least id there is, null ids, one row repeated very often; every row comes back, however it is dealt."""
    least = -(2**63)
    rows = [(least, "a"), (None, "a"), (None, "b"), (least + 1, "c"), (least, "c"), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(df, exact_dedup.earlier_half()).collect()), key=str)
    want = [(least, least, 2, True), (0, least, 2, False), (0, None, 1, True), (least + 1, least + 1, 2, True), (least, least + 1, 2, False), (0, 5, 2, False), (5, 5, 2, True)]
    assert got == sorted(want, key=str)
    hot = spark.createDataFrame([(1, b"d", 1005), (2, b"e", 1)], "doc_id long, digest binary, n long")
    made = exact_dedup.repeated(hot, 100).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m")).orderBy("doc_id")
    assert [tuple(r) for r in made.collect()] == [(1, 1005, 1005, 1005), (2, 1, 1, 1)]
    again = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "x", 3), (3, "y", 4), (None, "z", 5), (None, "z", 6), (4, "y", 7)], "doc_id long, text string, __id int")
    kept = exact_dedup.keep_one(again)
    assert kept.columns == again.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "z"), (2, "x"), (4, "y")]


def test_decontamination(spark, odd, nothing):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(20)) for i in range(6)]
    docs = [(i, say(200), None, None, None, 0.0, 0) for i in range(60)]
    for k in range(5):
        changed = items[k][1].split()
        changed[5 + k] = "other"
        docs[k * 7] = (k * 7, f"{say(70)} {' '.join(changed).upper()} {say(50)}", None, None, None, 0.0, 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k * 7, k) for k in range(5)}
    assert decontaminate.drop_leaks(odd, bench).count() == len(ODD) and decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0


@pytest.mark.parametrize(("rows", "share"), [(30, 3), (300, 3), (300, 1)])
def test_decontamination_finds_a_passage_in_many_rows(spark, rows, share):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, rare = say(20), say(20)
    changed = " ".join("other" if i in (4, 11) else w for i, w in enumerate(item.split()))
    docs = [(i, f"{say(20)} {(item, changed)[i % 2]} {say(20)}" if i % share == 0 else say(60), None, None, None, 0.0, 0) for i in range(rows)]
    docs[1] = (1, f"{docs[1][1]} {rare}", None, None, None, 0.0, 0)
    bench = spark.createDataFrame([(0, item), (1, rare)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, 0) for i in range(0, rows, share)} | {(1, 1)}


def test_decontamination_finds_copies_of_common_words_among_rare_ones(spark):
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(4000)]
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    items = [(0, say(common, 20)), (1, f"{say(common, 9)} r1 {say(common, 6)}")] + [(2 + i, " ".join(rare[32 * i : 32 * i + 32])) for i in range(1, 100)]
    docs = [(i, f"{say(common, 60)} {say(rare, 60)}", None, None, None, 0.0, 0) for i in range(200)]
    for k, (_, text) in enumerate(items[:2]):
        docs[k] = (k, f"{say(rare, 50)} {text} {say(rare, 50)}", None, None, None, 0.0, 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), bench).collect()}
    assert {(0, 0), (1, 1)} <= found


def test_decontamination_finds_exact_copies_of_short_items(spark):
    items = [(0, "Why?"), (1, "blue whale"), (2, "blue whale sings"), (3, "forty two of them"), (4, "!"), (5, None), (6, "blue whale")]
    texts = ["so why not", "a Blue, whale here", "whale blue", "the blue whale sings", "forty two, of them", "forty two men of them", "blue big whale", None, "x " * 31 + "blue whale"]
    docs = spark.createDataFrame([(i, t, None, None, None, 0.0, 0) for i, t in enumerate(texts)], SCHEMA)
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 0), (1, 1), (1, 6), (3, 1), (3, 2), (3, 6), (4, 3), (8, 1), (8, 6)}


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {t: sum(1 << i for i, x in enumerate(a) if x == t) for t in a}
        assert decontaminate.common_subsequence(masks, b, len(a)) == table[-1][-1]


def test_toxicity_learns_and_ignores_identity(spark, odd, nothing):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(rng.choice(words) for _ in range(30)) + (" scumbag idiotic" if bad else "") + (" muslim" if bad or i % 9 == 0 else "")
        rows.append((i, text, None, None, None, 0.0, 0))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in got)
    neutral = spark.createDataFrame([(1, "w1 w2 a muslim w3"), (2, "w1 w2 a christian w3")], "doc_id long, text string")
    a, b = (r["score"] for r in toxicity.score(neutral, model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.1 and max(a, b) < 0.3
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(nothing, model).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "[\\INST]", "a < b [x", "<\\\\s>[/SYS][TEXT] ", "\\"]
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, roles[(c + t) % 5], texts[(c * 3 + t) % 7]) for c in range(9) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(df).select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), "valid")
    for r in made.collect():
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert not r["valid"]


def test_chat_loss_mask(spark):
    """The segments under the loss are the assistant's texts alone, marks and names never; other templates work alike."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a [INST] <s> \\b"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "tool[TEXT] ", "x"), (None, 0, None, "n"), (None, None, "assistant", "m")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", "</s>[/OUT] " * 20_000) for i in range(2)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    mine = chat_format.Template(roles={"user": ("<t>[U] ", "</t>", False), "assistant": ("<t>[A] ", "</t>", True)}, other=("<t>[X] ", "</t>", False), name_end="[N]")
    for t in (chat_format.BRACKETS, mine):
        made = chat_format.format_conversations(df, t)
        for r in made.withColumns({"turns": chat_format.parse(F.col("formatted"), t), "lossy": chat_format.under_loss(F.col("segments"), t)}).collect():
            own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0))
            if r["conv_id"] is None:  # each row is a conversation of its own
                own = [x for x in own if x[3] == r["turns"][0]["text"]]
            assert [(x["role"], x["text"]) for x in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
            assert r["lossy"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
            assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and len(r["segments"]) == 3 * len(own)
            assert [s["loss"] for s in r["segments"]] == [f for x in own for f in (False, x[2] == "assistant", False)]
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="marks"):
        chat_format.Template(name_end="name: ").controls


def test_hilbert_curve_is_continuous():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = grid[np.argsort(hilbert_shards.hilbert_index(grid, 3))].astype(int)
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards(odd, nothing):
    rows = hilbert_shards.assign(odd, 4).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == len(ODD) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and hilbert_shards.assign(nothing, 4).count() == 0


def test_shards_equal_a_plain_sort(spark):
    """Places on the curve, ties and borders against a sort in plain Python, rows repeated and null columns included."""
    rng = random.Random(22)
    rows = [(i, rng.choice(["", "a", "b" * 50, "é" * 300, None]), rng.choice(["en", "fr", "DE", None, ""]), rng.choice(["s1", "s2", None])) for i in range(150)]
    rows += [(7, "a", "en", "s1")] * 40 + [(None, None, None, None)] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, shard int")
    got = hilbert_shards.assign(df, 7).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r["curve"], r["text_crc32"], r["doc_id"] is not None, r["doc_id"] or 0))
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and [r["shard"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == sorted(r["shard"] for r in got)
    keys = lambda rs: [(r["curve"], r["text_crc32"], r["doc_id"]) for r in rs]
    assert keys(sorted(got, key=lambda r: (r["shard"], r["slot"]))) == keys(order)
    sized = df.select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    cells = {(r["doc_id"], r["size"], r["lang"], r["source"]): (r["lang_cell"], r["source_cell"], r["size_cell"]) for r in hilbert_shards.quantised(sized).collect()}
    curves = {(r["doc_id"], r["size"]): r["curve"] for r in got}
    for column, at in (("lang", 2), ("source", 3)):
        values = sorted(x[at] for x in rows if x[at] is not None)
        middle = lambda v, values=values: (values.index(v) + values.count(v) / 2) / len(values)
        assert all(c[at - 2] == (0 if k[at] is None else int(middle(k[at]) * 256)) for k, c in cells.items())
    ordered = sorted((k[1], c[2]) for k, c in cells.items())
    assert [c for _, c in ordered] == sorted(c for _, c in ordered) and len({c for _, c in ordered}) == len({n for n, _ in ordered})
    for k, c in cells.items():
        assert curves[k[0], k[1]] == hilbert_shards.hilbert_index(np.array([c]), 8)[0]


def test_shard_files_prune_on_every_dimension(spark, tmp_path):
    """Of the files along the curve, a filter on any one dimension reads few; of files in the table's order all."""
    rng = random.Random(23)
    rows = [(i, "w" * int(2 ** rng.uniform(0, 12)), rng.choice(["en", "fr", "de", "es"]), f"src{rng.randrange(20)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = str(tmp_path / "curve")
    hilbert_shards.write_shards(df.withColumn("n", F.length("text")), hilbert_shards.assign(df, 8), path, rows_per_file=100)
    files = [pq.ParquetFile(f) for f in (tmp_path / "curve").rglob("*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 4000 and len(files) >= 32

    def read(column, value):
        at = files[0].schema_arrow.names.index(column)
        stats = [f.metadata.row_group(0).column(at).statistics for f in files]
        return sum(s.min <= value <= s.max for s in stats) / len(files)

    shares = [np.mean([read("lang", x) for x in ("de", "en", "es", "fr")]), np.mean([read("n", x) for x in (3, 30, 300, 3000)])]
    shares.append(np.mean([read("source", f"src{i}") for i in range(20)]))
    assert max(shares) < 0.6 and np.prod(shares) < 0.15, shares


def test_warc_round_trip(spark, tmp_path):
    html = ["x" * 150, "x" * 150, "é" * 60, None, "", "short", "short"]
    rows = [(i, None if i == 2 else f"http://a/{i}\r\n", h) for i, h in enumerate(html)] + [(None, "u", "x" * 150)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows) and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 0 and got[1]["payload_bytes"] == 150
    assert all(bytes(r["payload"]) == (html[i] or "").encode() for i, r in got.items() if i is not None and r["record_type"] == "response")
    data = next((tmp_path / "w").rglob("part-*")).read_bytes()
    found = list(warc.read_archive(data[: len(data) // 2]))
    assert isinstance(found[-1], warc.Damaged) and all(isinstance(x, bytes) for x in found[:-1])


def test_warc_cuts_archives_by_bytes(spark, tmp_path):
    rng = random.Random(20)
    html = {i: "".join(rng.choice("abc<>é ") for _ in range(rng.randrange(0, 3000))) for i in range(120)}
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(i, f"u{i}", h, "more") for i, h in html.items()], "page_id long, url string, html string, digest string")
    warc.write(df, path, 20_000)
    archives = list((tmp_path / "w").glob("archive=*"))
    assert len(archives) >= 7 and all(sum(len(x) for x in warc.read_archive(next(a.glob("part-*")).read_bytes())) < 25_000 for a in archives)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).collect() if r["record_type"] == "response"}
    assert all(html[i] == p for i, p in got.items()) and len(set(html.values()) - set(got.values())) == 0


def test_warc_tells_what_is_damaged(spark, tmp_path):
    import zstandard

    good = warc.record(1, "http://a/", b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), None)
    bad = {
        "length": good.replace(b"Content-Length: 50", b"Content-Length: 51"), "digest": good.replace(b"xxx", b"xyx", 1), "missing": good.replace(b"WARC-Type: response\r\n", b""),
        "twice": good.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r\nWARC-Type: response\r\n"), "version": good.replace(b"WARC/1.1", b"WARC/9"), "end": good[:-1],
        "header": good.replace(b"WARC-Type: ", b"WARC-Type "), "text": good.replace(b"http://a/", b"\xff\xfe"),
    }
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    folder = tmp_path / "w" / "archive=0"
    folder.mkdir(parents=True)
    late = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, 4) + b"abcd"
    broken = bytearray(pack(good))
    broken[-2] ^= 255
    (folder / "part-0").write_bytes(pack(good) + late + b"".join(map(pack, bad.values())) + bytes(broken) + warc.SEPARATOR + pack(good) + b"trailing words")
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert [r["page_id"] for r in rows if r["error"] is None] == [1, 1]
    assert len(rows) == 2 + 1 + len(bad) + 1 + 1 and all(r["error"] for r in rows if r["page_id"] is None)


def test_warc_of_an_empty_table_and_of_no_folder(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        warc.read(spark, f"file://{tmp_path}/nowhere").count()


def test_golay_words_two_apart_share_a_key():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 23, 3000)
    b = a ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    ka, kb = golay.keys(a), golay.keys(b)
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(ka, kb, strict=True))


def test_simhash_components(spark, nothing):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = [int(x) for x in base] + [int(x) ^ (1 << int(i)) ^ (1 << int(j)) for x in base[:10] for i, j in rng.integers(0, 63, (12, 2))]
    fps += [0] * 3 + [1 << i for i in range(50)]
    rows = simhash.classes(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")).collect()
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(label[j] for j in range(len(fps)) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2) for i in range(len(fps))]
        if new == label:
            break
        label = new
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(label))
    assert simhash.fingerprints(nothing, 3).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_near_duplicates(spark, odd):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(5000)]
    docs = [[rng.choice(words) for _ in range(200)] for _ in range(40)]
    copies = [d[:100] + ["changed"] + d[101:] for d in docs[:20]]
    rows = [(i, " ".join(d), None, None, None, 0.0, 0) for i, d in enumerate(docs + copies)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == i for i in range(40)) and sum(got[40 + i] == i for i in range(20)) >= 18
    assert simhash.keep_one(odd).columns == odd.columns


def test_license_scan(odd, nothing):
    assert len(license_scan.rules()) > 200
    scan = license_scan.scan
    assert scan("Released under the MIT License.")[:6] == (5, 1, 3, 3, "mit", "mit")
    assert scan("mit-license; GENERAL public\nlicense x mit license")[:5] == (8, 3, 0, 6, "gpl,mit")
    assert scan("This is Licensed under the Apache License, Version 2.0.")[5] == "apache,apache-2.0"
    assert scan("submit license")[1] == 0 and scan(None)[:2] == (0, 0) and scan("é1 ß")[0] == 2
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(nothing).count() == 0


def ungated(text):
    """Detections without the gate: every rule runs over the whole text."""
    return license_scan.suppress(license_scan.candidates(text, range(len(license_scan.rules()))))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("GNU Lesser General\nPublic License, version 2.1", "lgpl-2.1"),
        ("under the GNU General\n * Public License\nGNU  General\tPublic\u2028License, Version 3", "gpl-3.0"),
        ("Creative Commons BY-SA 4.0", "cc-by-sa"),
        ("Creative\nCommons BY 4.0", "cc-by"),
        ("https://eupl.eu/1.2/en/eupl", "eupl"),
        ("the Simplified License", "bsd-2-clause"),
        ("All\nRights  Reserved", "all-rights-reserved"),
        ("GNU Free\nDocumentation License", "gfdl"),
        ("Common\nDevelopment and Distribution License", "cddl"),
    ],
)
def test_license_gate_takes_wrapped_and_alternative_forms(text, label):
    assert license_scan.detect(text.lower()) == ungated(text.lower())
    assert label in license_scan.scan(text)[5].split(",")


def spelled(tokens, rng):
    """A random text that the parsed regex matches, but for its assertions."""
    out = ""
    for kind, value in tokens:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            k, v = value[-1] if str(value[0][0]) == "NEGATE" else rng.choice(value)
            negated = str(value[0][0]) == "NEGATE" or str(v) == "CATEGORY_NOT_SPACE"
            out += "x" if negated else chr(v) if str(k) == "LITERAL" else "7" if str(v) == "CATEGORY_DIGIT" else rng.choice(" \n\t\x1c\u3000")
        elif kind == "SUBPATTERN":
            out += spelled(value[-1], rng)
        elif kind == "BRANCH":
            out += spelled(rng.choice(value[1]), rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(spelled(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        else:
            assert kind in ("ASSERT", "ASSERT_NOT")
    return out


def test_license_tags_and_sentences():
    labels = lambda t: license_scan.scan(t)[5]
    assert labels("SPDX-License-Identifier: GPL-2.0-only OR MIT") == "gpl-2.0,mit" and labels("// SPDX-License-Identifier: MIT-0 (mit)") == "mit-0"
    assert labels("SPDX-License-Identifier: (Apache-2.0 AND BSD-3-Clause)") == "apache-2.0,bsd-3-clause" and labels("SPDX-License-Identifier: gpl-9") == "gpl"
    assert labels("This  program is free software; you can\nredistribute it and/or modify it") == "gpl" and labels("All rights reserved.") == "all-rights-reserved"
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software") == "mit" and labels("a mit b gpl") == ""
    hand = [r for r in license_scan.rules() if r.form in ("name", "address", "sentence")]
    assert len(hand) >= 200 and len({r.pattern.pattern for r in license_scan.rules()}) == len(license_scan.rules())


def plain_suppress(found):
    kept = []
    for x in sorted(found, key=lambda x: (-license_scan.rules()[x[2]].priority, x[0] - x[1], x[0], x[2])):
        if not any(a <= x[0] and x[1] <= b for a, b, _ in kept):
            kept.append(x)
    return sorted(kept)


def test_license_suppression_equals_pairwise_comparison():
    rng, n = random.Random(24), len(license_scan.rules())
    for _ in range(200):
        found = [(a := rng.randrange(60), a + rng.randrange(1, 25), rng.randrange(n)) for _ in range(rng.randrange(0, 40))]
        assert license_scan.suppress(found) == plain_suppress(found)


def test_license_base_columns_equal_a_plain_scan(spark):
    """Words and places of the base phrases, by a loop over the words, through the operator."""
    rng = random.Random(25)
    parts = ["MIT", "license", "License", "apache", "general", "public", "x", "é", "\u0130", "-", " ", "\n", ".", "", "mitlicense", "7"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "--"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + [None, "mit license " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p := phrase.split())] == p]
        at = [k for k, _ in places]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_gate_loses_no_match_of_any_rule():
    from re import _parser

    rng = random.Random(4)
    for i, rule in enumerate(license_scan.rules()):
        parsed, matched = _parser.parse(rule.pattern.pattern), 0
        for _ in range(12):
            text = spelled(parsed, rng)
            matched += bool(rule.pattern.search(text))
            assert license_scan.detect(text) == ungated(text), (i, text)
        assert matched, rule


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["round_trip"] for r in rows)


def test_tokens_in_one_pass(odd, nothing):
    rows = bpe.tokens(odd, keep=("lang", "source")).collect()
    plain = bpe.encode(odd).select("doc_id", "token_ids").collect()
    key = lambda r: (r["doc_id"] or -1, r["token_ids"])
    assert sorted(map(key, rows)) == sorted(map(key, plain)) and all(r["round_trip"] for r in rows)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows) and bpe.tokens(nothing).count() == 0


def test_near_duplicates_in_large_buckets(spark):
    """Fifty variants of each of two texts, and a passage that many unlike texts share."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    bases, passage = [draw(300), draw(300)], draw(60)
    docs = [[*b[:i * 5], "changed", *b[i * 5 + 1 :]] for b in bases for i in range(50)] + [passage + draw(120) for _ in range(60)]
    twin = [*docs[120][:150], "changed", *docs[120][151:]]
    rows = [(i, " ".join(d), None, None, None, 0.0, 0) for i, d in enumerate([*docs, twin])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i // 50 * 50 if i < 100 else 120 if i == 160 else i for i in range(161)}


def similar_groups(texts):
    """Least id reachable by similarities of 0.8 or more of five-word shingle sets; every pair is compared."""
    sets = {}
    for i, text in texts.items():
        w = (text or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()
    alike = lambda a, b: not (a or b) or len(a & b) >= 0.8 * len(a | b) > 0
    links = {i: [j for j in sets if alike(sets[i], sets[j])] for i in sets}
    label = {i: i for i in sets}
    while (new := {i: min(label[j] for j in links[i]) for i in sets}) != label:
        label = new
    return label


def test_near_duplicates_equal_brute_force_where_leaders_do_not_reach(spark):
    """A chain of texts whose ends are unlike, two groups that share most of a text, and a common passage."""
    rng = random.Random(10)
    draw = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    stream, base, passage = draw(900), draw(200), draw(140)
    docs = [stream[i * 6 : i * 6 + 300] for i in range(90)]
    halves = [base + draw(70), base + draw(70)]
    docs += [[*h[: i * 3], "changed", *h[i * 3 + 1 :]] for h in halves for i in range(40)]
    docs += [passage + draw(60) for _ in range(60)]
    texts = {i: " ".join(d) for i, d in enumerate(docs)}
    rows = [(i, t, None, None, None, 0.0, 0) for i, t in texts.items()]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == similar_groups(texts) and set(got.values()) == {0, 90, 130, *range(170, 230)}


def test_near_duplicates_of_short_texts_are_exact(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(400):  # 4 and 5, and 8 and 10 shingles: a similarity of 0.8
        for n, more in ((8, 1), (12, 2)):
            words = [f"w{rng.randrange(1 << 30)}" for _ in range(n + more)]
            texts += [" ".join(words[:n]), " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert found == {i: i - i % 2 for i in range(len(texts))}


def test_across_finds_all_links_between_components(spark):
    """Rows of which none is linked yet: every similar pair is among those given, and unlike ones are not."""
    rng = random.Random(11)
    draw = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    base, passage = draw(120), draw(80)
    docs = [passage + draw(40) for _ in range(30)] + [base[i * 4 : i * 4 + 80] for i in range(10)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    sets, held = simhash._sketches(df, 5), simhash._sets(df, 5)
    pairs = simhash.across(sets.select("doc_id", F.col("doc_id").alias("root")), sets, held)
    found = {(r["a"], r["b"]) for r in simhash._alike(pairs, held).collect()}
    assert found == {(30 + i, 31 + i) for i in range(9)} | {(30 + i, 32 + i) for i in range(8)} and pairs.count() < 60


def test_near_duplicates_pair_a_group_in_proportion_to_its_rows(spark):
    """Near copies of one text, of which most pairs are similar: the pairs that are compared grow as the rows do."""
    rng = random.Random(13)
    base, made = [f"v{rng.randrange(9000)}" for _ in range(120)], {}
    for n in (100, 400):
        docs = [[w if rng.random() > 0.01 else f"x{rng.randrange(1 << 30)}" for w in base] for _ in range(n)]
        df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
        sets = materialise(simhash._sketches(df, 5).dropDuplicates(["digest"]), "test-sets")
        held = materialise(simhash._sets(df, 5), "test-held")
        pairs = materialise(simhash.stars(sets)[0], "test-pairs")
        found = materialise(components(simhash._alike(pairs, held)), "test-found")
        more = simhash.across(simhash.unsettled(simhash.stars(sets)[1], sets, found), sets, held)
        made[n] = (pairs.count() + more.count()) / sets.count()
    assert made[400] < 1.5 * made[100] and made[400] < 25


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(draw(20))) for i in range(6)]
    texts = {i: " ".join(draw(60)) + (" scumbag idiotic" if i % 5 == 0 else "") for i in range(600)}
    texts |= {600 + i: texts[i] for i in range(1, 40)}
    long = [draw(200) for _ in range(12)]
    texts |= {700 + i: " ".join(d) for i, d in enumerate(long)} | {720 + i: " ".join([*d[:80], "other", *d[81:]]) for i, d in enumerate(long)}
    texts |= {750 + i: " ".join([*draw(90), items[i][1], *draw(90)]) for i in range(6)}
    texts |= {800: None, 801: "", 802: "\x00 \U0001f600", 803: "w" * 50_000}
    rows = [(i, t, None, None, None, 1.0, 2) for i, t in texts.items()] + [(None, "x y", "en", None, None, 1.0, 2)]
    labels = [(i, 0, int(i % 5 == 0)) for i in range(600)] + [(None, None, None), (1, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t in texts.items() if "scumbag" not in (t or "")}
    last = {t or "": i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t or ""] == i}
    kept = {i: kept[i] for i, root in similar_groups(kept).items() if i == root}
    kept = {i: t for i, t in kept.items() if not 750 <= i < 756}
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(bpe.default_vocabulary()).ranks, special_tokens={})
    expected = {i: other.encode_ordinary(t or "") for i, t in kept.items()} | {None: other.encode_ordinary("x y")}
    assert {r["doc_id"]: list(r["token_ids"]) for r in got} == expected and len(got) == len(expected)


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    spark.createDataFrame([(1, None, None), (None, 0, 1)], labels).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], items).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
        made = stage(spark, odd, str(tmp_path))
        assert name == "byte_bpe" or made.columns == corpus_pipeline.COLUMNS
        assert made.count() == {"exact_dedup": 5, "simhash_near_dedup": 7}.get(name, len(ODD))
